"""Everything that reading and writing may raise."""


class BytelensError(Exception):
    """Base of all errors that callers need to handle."""


class ContainerError(BytelensError):
    """A container that can't be read."""


class BlockError(BytelensError):
    """A bytecode block that can't be parsed."""


class CodeError(BytelensError):
    """Instructions that can't be decoded in strict mode."""
