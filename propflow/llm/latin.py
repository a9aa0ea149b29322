"""Texts of Latin letters, on which Python's patterns and those of tokenizer files agree.

Characters below U+0250 but one: no canonical composition changes them, each
lower-cases to one character, and what is a letter, a number or white space is
written out here from the character database.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

_END = 0x250
#: U+0130, whose lower case is two characters.
_TWO = 0x130
#: White space as patterns of tokenizer files have it (Unicode's White_Space).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]))
LETTERS, NUMBERS = ("".join(chr(c) for c in range(_END) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
#: Finds what is not of this kind.
OTHER = re.compile(f"[{chr(_TWO)}{chr(_END)}-{chr(0x10FFFF)}]")
#: Where a long text may be cut: a blank between ASCII letters.
_CUT = re.compile("(?<=[a-z])(?= [a-z])")


def parts(text: str, most: int) -> Iterator[str]:
    """A text in parts of little more than ``most`` characters, each but the first from a blank between letters on."""
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for letters from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in own else next(others) for b in range(256)}
