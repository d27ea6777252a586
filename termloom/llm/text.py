"""Character-level normal forms shared by the text operators of this subpackage.

Three forms are used:

* ``plain(text)``     - the text with compatibility forms, invisible characters
                        and loose combining marks put aside; letters keep their case.
* ``skeleton(text)``  - strings that look alike get the same skeleton; case and
                        accents still count.
* ``fold_word(word)`` - skeleton that also ignores case and accents, for
                        matching passages word by word.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts drawn like a Latin letter.
LOOKALIKE = {
    # Cyrillic small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Cyrillic capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    # Greek small
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p",
    # Greek capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Kinds of hyphen that NFKD leaves apart.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Characters that are not drawn.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f"
    "\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb"
)
# Small letters whose capitals look like a Latin capital.
CASED_LOOKALIKE = {
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "β": "b", "ε": "e",
    "ζ": "z", "η": "h", "κ": "k", "μ": "m", "ν": "v", "τ": "t", "υ": "y", "χ": "x", "n": "v",
}

_invisible = re.compile(f"[{INVISIBLE}]")
_irregular = re.compile(f"[{INVISIBLE}\u0300-\u036f\u00a0\u2000-\u200a\u2010\u2011\u202f\u205f\u3000\u2160-\u2188\ufb00-\ufb06\uff00-\uffef]")
_marks = re.compile("[\u0300-\u036f]")

_SKELETON = {ord(k): v for k, v in LOOKALIKE.items()}
_SKELETON |= {ord(h): "-" for h in HYPHENS}
_SKELETON |= {c: " " for c in (9, 10, 11, 12, 13)}
_FOLD = {ord(k): v for k, v in (LOOKALIKE | CASED_LOOKALIKE).items()}
_FOLD |= {c: None for c in range(0x300, 0x370)}


def plain(text: str) -> str:
    """Compatibility forms composed, invisible characters and loose marks removed."""
    if text.isascii() or not _irregular.search(text):
        return text
    return _marks.sub("", _invisible.sub("", unicodedata.normalize("NFKC", text)))


def canonical(text: str) -> str:
    """Table normalisation: the composed form without invisible characters, with
    plain spaces and hyphens. Letters keep their script."""
    text = _invisible.sub("", unicodedata.normalize("NFKC", text))
    return "".join("-" if c in HYPHENS else " " if c.isspace() else c for c in text)


def skeleton(text: str) -> str:
    """Equal for two strings exactly if they look the same: compatibility
    forms, accents, invisible characters, spaces, hyphens and look-alike
    letters are unified; case, other letters and other signs are kept."""
    if text.isascii():
        return text.translate(_SKELETON)
    return _invisible.sub("", unicodedata.normalize("NFKD", text)).translate(_SKELETON)


def fold_word(word: str) -> str:
    """Word key for passage matching: case, accents and look-alikes put aside."""
    word = word.lower()
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word).lower()
    return word.translate(_FOLD)


WORD = re.compile(r"[^\W_]+")
