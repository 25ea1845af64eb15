"""What can be wrong with a pattern query."""

from __future__ import annotations


class PatternError(ValueError):
    """kind is syntax, semantic, unsupported or execution; position an offset in the text or None."""

    def __init__(self, message: str, kind: str = "syntax", position: int | None = None) -> None:
        super().__init__(message)
        self.kind = kind
        self.position = position

    def as_dict(self) -> dict:
        return {"error": str(self), "error_kind": self.kind, "position": self.position}
