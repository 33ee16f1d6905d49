"""What encoding octets are in, from the octets alone.

Each candidate is tried as a machine that reads the octets: what it cannot read, and signs that texts do not have, count against
it; pairs of neighbours that its languages are full of count for it.  The best one wins, if it reads nearly all."""

from __future__ import annotations

import codecs
import unicodedata

#: Candidates, in the order in which they win ties.
CANDIDATES = ("utf-8", "cp932", "euc_jp", "cp1252", "cp1251", "cp1250")
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Share of signs that must be readable.
READABLE = 0.9


def wide(data: bytes) -> str | None:
    """UTF-16 without a mark: in scripts of few characters every second octet is the same, mostly zero."""
    if len(data) < 4:
        return None
    even, odd = data[0::2].count(0) / len(data[0::2]), data[1::2].count(0) / len(data[1::2])
    return "utf-16-le" if odd > 0.3 > even else "utf-16-be" if even > 0.3 > odd else None


def _kind(c: str) -> str:
    """Classes of signs whose neighbourhood tells encodings apart."""
    if c < "\x80":
        return "a" if c.isalpha() else " "
    if "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "　" <= c <= "〿" or "！" <= c <= "～":
        return "j"
    if "｡" <= c <= "ﾟ":
        return "h"
    if "Ѐ" <= c <= "ӿ":
        return "c"
    return "l" if c.isalpha() else "x"


#: What a pair of neighbours says, of which one at least is beyond ASCII: usual, or hardly ever in a text.
_USUAL = {"jj", "j ", " j", "al", "la", "ll", " l", "l ", "cc", " c", "c "}
_RARE = {"hh", "ah", "ha", "hl", "lh", "jh", "hj", "ac", "ca", "lc", "cl", "aj", "ja", "jl", "lj"}


def score(data: bytes, encoding: str) -> tuple[float, float]:
    """(share of readable signs, pairs that speak for the encoding less those against it, a pair)."""
    text = data.decode(encoding, "replace")
    unread = sum(c == "�" or (unicodedata.category(c) in ("Cc", "Cn", "Co") and c not in "\t\n\r\f") for c in text)
    kinds = "".join(map(_kind, text))
    pairs = [kinds[i : i + 2] for i in range(len(kinds) - 1) if text[i] >= "\x80" or text[i + 1] >= "\x80"]
    # Cyrillic in its own range is letters for the Latin tables too; long runs of accented letters are no word
    against = sum(p in _RARE for p in pairs) + sum(kinds[i : i + 3] == "lll" for i in range(len(kinds) - 2))
    upper_inside = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
    return 1 - unread / max(1, len(text)), (sum(p in _USUAL for p in pairs) - 2 * against - 2 * upper_inside) / max(1, len(pairs))


def detect(data: bytes, head: int = 1 << 16) -> str | None:
    """The encoding, or None if no candidate reads it.  head: octets that are looked at (the guess is about a file's encoding, not its content)."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    data = data[:head]
    if found := wide(data):
        return found
    found = [(score(data, c), -i, c) for i, c in enumerate(CANDIDATES)]
    fit = [(round(read * 50) / 50 + pairs, first, c) for (read, pairs), first, c in found if read >= READABLE and pairs > 0]
    return max(fit)[2] if fit else None
