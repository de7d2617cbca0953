"""Errors raised while a workflow is wired or run: a reason and a hint."""


class WorkflowError(Exception):
    def __init__(self, reason: str, hint: str = "") -> None:
        super().__init__(f"{reason} {hint}".strip())
        self.reason, self.hint = reason, hint


class WrongParameter(WorkflowError):
    """A parameter has a value outside of what it allows."""


class InputNotAvailable(WorkflowError):
    """A needed input isn't there."""


class InvalidInput(WorkflowError):
    """An input is there, but has the wrong shape."""


class StepCreation(WorkflowError):
    """A step can't be wired like this."""


class UnknownTransform(WorkflowError):
    """A model offers none of the known ways to transform."""


class UtilError(WorkflowError):
    """A helper can't do what it is asked for."""
