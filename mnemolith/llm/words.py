"""Texts as comparable words: letter case, accents, punctuation, layout and markup make no difference."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.I | re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_EMPHASIS = re.compile(r"[*`~­​-‏⁠﻿]+")
_COMBINING = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(_EMPHASIS.sub("", text.casefold()))
