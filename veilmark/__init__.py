"""Finding, masking and restoring sensitive data in text with DataFrame plans."""

from veilmark.shipping import ship

__all__ = ["ship"]
