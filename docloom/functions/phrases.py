"""Patterns built from words: labels and signs are kept as plain text, and become patterns here.

In a phrase, an accented letter stands for itself and its plain letter, a blank for any white space, ``°`` for the
sign or the letter o, ``'`` for any apostrophe or none, ``.`` for a dot or none, ``-`` for a hyphen, a blank or
nothing, ``:`` for a colon or hyphen, with a blank before it or not, ``#`` for digits, ``|`` for the border of a word,
and ``?`` makes the letter before it optional. All else stands for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Letters with accents, as a label may be written with or without them.
LETTERS = {"à": "[àâa]", "â": "[âàa]", "ç": "[çc]", "é": "[éèêe]", "è": "[èéêe]", "ê": "[êéèe]", "î": "[îi]", "ô": "[ôo]", "û": "[ûùu]", "ù": "[ùûu]"}
SIGNS = {"°": "[°o]", "'": "['’`]?", ".": "\\.?", "-": "[-\\s]?", ":": "\\s*[:\\-]", "#": "\\d+", "|": "\\b", "?": "?"}


def words(phrase: str, gap: str = "\\s+") -> str:
    """The phrase as a pattern; gap stands between its words."""
    return "".join(gap if c == " " else LETTERS.get(c) or SIGNS.get(c) or re.escape(c) for c in phrase.replace(" :", ":"))


def any_of(phrases: list[str], gap: str = "\\s+") -> str:
    return "(?:" + "|".join(words(p, gap) for p in phrases) + ")"


def sign(phrase: str) -> str:
    """The phrase as words of their own: no letter or digit goes on at a side that ends with one."""
    before, after = ("\\b" if phrase[0].isalnum() else ""), ("\\b" if phrase[-1].isalnum() or phrase[-1] in "#?" else "")
    return before + words(phrase) + after


def signs(phrases: list[str]) -> str:
    return "(?:" + "|".join(map(sign, phrases)) + ")"


#: Between a label and its value.
LINK, STRICT = "\\s*[:\\-]?\\s*", "\\s*[:\\-]\\s*"


@dataclass(frozen=True)
class Labelled:
    """A value that stands behind one of the labels (or before it), or by itself where there are none."""

    labels: tuple[str, ...]
    value: str
    behind: bool = True
    strict: bool = False  # a colon or hyphen must stand between them

    def pattern(self, values: dict[str, str]) -> str:
        value = values[self.value]
        if not self.labels:
            return value
        said = any_of(list(self.labels), "\\s*")
        return said + (STRICT if self.strict else LINK) + value if self.behind else value + "\\s*" + said


def loose(word: str) -> str:
    """A word whose letters may carry any accent."""
    plain = {c: cls for cls in LETTERS.values() for c in cls.strip("[]")}
    return "".join(plain.get(c) or re.escape(c) for c in word)


def times(least: int, most: int | None) -> str:
    return f"{{{least},{'' if most is None else most}}}"


def code(least: int, most: int, first: str = "A-Za-z0-9", whole: bool = False) -> str:
    """The one shape of a code: letters, digits and the joiners - / _, beginning with a letter or digit. whole: nothing of that kind follows."""
    inside = "[A-Za-z0-9_/\\-]"
    return f"([{first}]{inside}{times(least - 1, most - 1)})" + (f"(?!{inside})" if whole else "")


def coded(heads: list[str], *groups: tuple[int, int], joiner: str = "-/") -> str:
    """A code of its own: one of the words, then groups of so many digits, each behind a joiner or none."""
    return "\\b(" + any_of(heads, "") + "".join(f"[{joiner}]?\\d{times(*g)}" for g in groups) + ")\\b"


def digits(least: int, most: int | None, gaps: bool = False) -> str:
    """A number of so many digits, with blanks between them or not."""
    return f"(\\d{times(least, most)})" if not gaps else f"(\\d(?:\\s*\\d){times(least - 1, None if most is None else most - 1)})"


def line(least: int, most: int, first: str = "") -> str:
    """What stands on a line, of so many characters; first: which one begins it."""
    return f"({first}[^\\n]{times(least - bool(first), most - bool(first))})"
