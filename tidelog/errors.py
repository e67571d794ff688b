"""What the API raises; per-row failures of a batch are outcomes instead."""


class TidelogError(Exception):
    """Any failure of the engine."""


class TooLarge(TidelogError):
    """A key or value whose UTF-8 length doesn't fit its 32-bit prefix."""

    def __init__(self, part: str, length: int, most: int):
        super().__init__(f"{part} of {length} bytes is longer than {most}")
        self.part, self.length, self.most = part, length, most


class CorruptRecord(TidelogError):
    """A record that ends early or has an unknown tag, where reading was told to fail."""


class ConfigError(TidelogError):
    """An environment variable that doesn't parse."""


class NotFound(TidelogError):
    """A key without a live value, where one was required."""
