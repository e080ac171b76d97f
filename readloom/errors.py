"""Errors by category; each category has a stable exit code."""

from __future__ import annotations

# Categories and exit codes.
EXIT_CODES = {
    "usage": 2, "configuration": 3, "input_not_found": 4, "input_format": 5, "input_corrupt": 6, "input_unsorted": 7, "unsupported_record": 8, "reference_required": 9,
    "reference_mismatch": 10, "target_format": 11, "target_contig": 12, "resource_limit": 13, "output_exists": 14, "output_io": 15, "compatibility_unavailable": 16, "internal_invariant": 70,
}


class LoomError(Exception):
    """An error with a category of EXIT_CODES; `detail` may hold paths or names and is shown only on request."""

    def __init__(self, category: str, message: str, detail: str | None = None):
        assert category in EXIT_CODES, category
        super().__init__(f"{category}: {message}")
        self.category, self.message, self.detail = category, message, detail

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.category]

    def text(self, sensitive: bool = False) -> str:
        return f"{self}: {self.detail}" if sensitive and self.detail else str(self)
