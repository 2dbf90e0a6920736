"""Words of a text, whatever its case, accents, spacing, punctuation, look-alike and invisible characters."""

from __future__ import annotations

import re
import unicodedata

CJK = "぀-ヿ㐀-鿿豈-﫿"
WORD = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
# Letters (in lower case, accents removed) that look like a Latin letter in one of their cases.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕһԁԛԝαβεζηικμνορτυχıłøđħ", "abekmhopctyxijshdqwabeznikmvoptuxilodh", strict=True))
SIMILAR = re.compile("[" + "".join(LOOK_ALIKES) + "]")
TABLE = {ord(a): b for a, b in LOOK_ALIKES.items()}
# combining marks, soft hyphens, zero-width characters, direction marks, variation selectors, byte order marks
UNSEEN = re.compile("[­̀-ͯ҃-҉؜༌ᅟᅠ᪰-᫿᷀-᷿​-‏‪-‮⁠-⁯⃐-⃿゙゚︀-️︠-︯﻿￹-￻\U000e0000-\U000e0fff]+")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = UNSEEN.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return text.translate(TABLE) if SIMILAR.search(text) else text


def words(text: str) -> list[str]:
    return WORD.findall(fold(text))
