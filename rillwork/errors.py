"""Kinds of failure: wrong parameters, and work that could not be done."""


class ValidationError(ValueError):
    """Parameters or columns that an operator can't work with."""


class ProcessError(RuntimeError):
    """An operator failed while its plan was built."""
