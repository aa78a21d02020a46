"""Errors of this package."""


class RuleError(ValueError):
    """A rules file, rule or condition that isn't one."""


class ReplyError(ValueError):
    """A model's reply that holds no usable object."""
