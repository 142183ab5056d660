"""Words of a text, whatever its typography."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
DIVIDED = re.compile("[-\u2010](?<=\\w.)\\s*\n\\s*(?=\\w)")
UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def plain(text: str) -> str:
    """Case folded, compatibility forms unified, invisible characters removed, words divided at line ends joined."""
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKC", text)).replace("\u00a0", " ")
    text = text.casefold()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return DIVIDED.sub("", text)


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
