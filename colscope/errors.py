"""Errors by the exit code that the command line gives them."""


class ColscopeError(Exception):
    """Something went wrong while running: exit code 1."""

    code = 1


class UsageError(ColscopeError):
    """The request makes no sense: unknown option value, bad expression, missing column. Exit code 2."""

    code = 2


class CheckFailed(ColscopeError):
    """A check or contract did not hold; all results were reported before. Exit code 3."""

    code = 3


class PartlyFailed(ColscopeError):
    """Some of several outputs could not be made. Exit code 4."""

    code = 4
