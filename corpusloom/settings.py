"""What may be set about reading trees, from a file or by hand."""

from __future__ import annotations

import json
from dataclasses import dataclass

from corpusloom.functions import rules


@dataclass(frozen=True)
class Settings:
    """Patterns of names that are left out, suffixes that are taken as binary, and the largest file read."""

    ignored: tuple[str, ...] = tuple(rules.IGNORED)
    binary_suffixes: tuple[str, ...] = tuple(rules.BINARY_SUFFIXES)
    most_bytes: int = rules.MOST_BYTES

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """The settings of a JSON file (`ignored_directories`, `binary_extensions`, `max_file_size_mb`).

        What the file lacks keeps its default; repeats in lists count once, the first decides the
        order. A file that is missing or not as described gives the defaults.
        """
        try:
            with open(path or "", encoding="utf-8") as f:
                given = json.load(f)
            own = cls(
                _names(given.get("ignored_directories"), cls.ignored),
                tuple(s.lower() for s in _names(given.get("binary_extensions"), cls.binary_suffixes)),
                int(float(given["max_file_size_mb"]) * 2**20) if "max_file_size_mb" in given else cls.most_bytes,
            )
        except (OSError, ValueError, TypeError, AttributeError, OverflowError):
            return cls()
        return own


def _names(given: list[str] | None, default: tuple[str, ...]) -> tuple[str, ...]:
    if given is None:
        return default
    if not isinstance(given, list) or not all(isinstance(x, str) for x in given):
        raise TypeError("a list of strings is needed")
    return tuple(dict.fromkeys(given))
