"""Words of crawled texts: what is left when case, punctuation, markup and invisible signs are gone."""

from __future__ import annotations

import html
import re
import unicodedata

#: Invisible characters.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|<!doctype[^<>]*>", re.I | re.S)
_HIDDEN = re.compile(r"<(head|script|style)\b.*?</\1\s*>", re.I | re.S)
_HANGUL_RUN = re.compile("[가-힣]{2,}")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile("�|[À-ô][\u0080-¿Œ-Ÿˆ-›€™]|[^\\W\\d_]\\?[^\\W\\d_]|[\u0080-\u009f]")


def plain(text: str) -> str:
    """Without markup, character entities and invisible characters; lines are kept."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", text))
    return text if text.isascii() else INVISIBLE.sub("", text)


def words(text: str | None) -> list[str]:
    """Words of a text in order; [] for a missing or empty one."""
    if not text:
        return []
    text = plain(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def is_broken(text: str) -> bool:
    """Whether a text shows signs of having been decoded with the wrong character set."""
    return not text.isascii() and _BROKEN.search(text) is not None or "?" in text and _BROKEN.search(text) is not None


def decode(raw: bytes) -> str:
    """Text of a page by its bytes alone: UTF-8 if they are that, else the multi-byte set they
    fit strictly, else a western one. Markup is taken out, one line per block."""
    for charset in ("utf-8", "cp949", "cp1252"):
        try:
            page = raw.decode(charset)
        except UnicodeDecodeError:
            continue
        # western bytes may fit cp949 by chance, but then as single syllables between Latin letters
        if charset == "cp949" and 2 * sum(map(len, _HANGUL_RUN.findall(page))) < sum(not c.isascii() for c in page):
            continue
        break
    else:
        page = raw.decode("latin-1")
    page = _HIDDEN.sub("", page)
    return html.unescape(_TAG.sub("", page)).strip()


def mended(text: str | None, raw: bytes | None) -> str:
    """The text, or where its characters are broken the page decoded anew."""
    if not text:
        return text or ""
    return decode(raw) if raw and is_broken(text) else text
