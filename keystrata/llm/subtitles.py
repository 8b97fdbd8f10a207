"""The spoken text of subtitle files, and words that survive damage to their characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: What single characters are mistaken for, both ways, when subtitles are read from pictures.
#: Each is written as what both readings become: an h is read as li, so h becomes what li becomes.
CONFUSED = {
    "h": "ll", "u": "ll", "m": "rn", "w": "vv",
    "i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "c": "e", "f": "t",
}

#: Phrases that mark a cue as an advert or credit.
ADVERTS = [
    "corrections by", "subtitles by", "subs by", "s u b s b y", "untertitel:", "downloaded from", "become a member at",
    "advertise here", "watch any clip", "rate this file", "traduit par",
]
#: Endings of host names.
HOST_ENDINGS = ["example", "invalid", "test", "com", "net", "org", "info", "tv"]

_READINGS = {
    "o": "[o0]", "e": "[ec]", "c": "[ce]", "i": "[il1|]", "l": "[li1|]", "s": "[s5]", "t": "[tf]", "f": "[ft]",
    "m": "(?:m|rn)", "w": "(?:w|vv)", "h": "(?:h|li)", "u": "(?:u|ii|[^\\x00-\\x7f]+)", " ": r"\s+",
}


def _damaged(phrase: str) -> str:
    """A pattern for the phrase and its misreadings."""
    return "".join(_READINGS.get(c, re.escape(c)) for c in phrase)


_ADVERT = re.compile(
    "|".join(
        [
            rf"[\w-]\.(?:{'|'.join(_damaged(e) for e in HOST_ENDINGS)})\b",
            r"-=[^\n]*=-",
            r"~[^~\n]+~",
            *[_damaged(p) for p in ADVERTS],
        ]
    ),
    re.IGNORECASE,
)
_HOST = re.compile(rf"[\w-]\.(?:{'|'.join(_damaged(e) for e in HOST_ENDINGS)})\b", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^>\n]*>|\{\\[^}\n]*\}")
_SOUND = re.compile(
    r"\[[^\]\[]{0,60}\]|\[[^\]\n]*$|\([^)(]{0,60}\)|\([^)\n]*$|\{[^}{]{0,60}\}|\{[^}\n]*$|♪[^♪\n]*♪?|#[^#\n]*#|\*[^*\n]*\*"
    r"|â™ª[^\n]*?(?:â™ª|$)|Ã¢â„¢Âª[^\n]*?(?:Ã¢â„¢Âª|$)",
    re.MULTILINE,
)
_SPEAKER = re.compile(r"^[ \t]*-?[ \t]*[A-Z][A-Z0-9'À-Þ�]{1,24}(?: #?\d{1,2})?:(?=\s|$)", re.MULTILINE)


_FOLD = str.maketrans(CONFUSED)
_ODD = re.compile(r"[^0-9a-z]+")


def skeleton(word: str) -> str:
    """The word as it reads with all confusable characters united: lower-case ASCII letters and digits.

    Letters beyond ASCII are left out, as a wrong encoding changes them to others beyond ASCII; so are
    punctuation marks.  A word of such letters only has an empty skeleton.
    """
    return _ODD.sub("", word.lower().translate(_FOLD))


#: What ``word_key`` gives for a word of which nothing certain is left, as of one accented letter alone.
UNKNOWN = "~"
#: Stands between cues in ``marked``; a private-use character, so no text has it as a word.
CUE_MARK = "\ue000"
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


def repaired(word: str) -> str:
    """The word with a wrong decoding (UTF-8 read as a one-byte code, once or twice) undone where that is possible."""
    for _ in range(2):
        for code in ("cp1252", "latin-1"):
            try:
                word = word.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            break
        if word.isascii():
            break
    return word


def _other_script(c: str) -> bool:
    return c.isalpha() and c > "\u036f" and "LATIN" not in unicodedata.name(c, "LATIN")


def word_key(token: str) -> str | None:
    """What a word is known by whatever happened to its characters; None for a token without letter or digit.

    A word with an ASCII letter or digit is known by its skeleton, as its other letters may be damaged or wrongly
    decoded.  A word without one is known by all its letters, case folded, after a wrong decoding is undone; if it is
    one letter alone, of an alphabet with two cases, nothing certain is left of it.
    """
    if not is_word(token):
        return None
    if token.isascii():
        return skeleton(token) or UNKNOWN
    if not _ODD.sub("", token.lower()):
        folded = "".join(c for c in unicodedata.normalize("NFKC", repaired(token)).casefold() if c.isalnum())
        if any(_other_script(c) for c in folded) and (len(folded) > 1 or folded.upper() == folded):
            return folded
    return skeleton(token) or UNKNOWN


# of each phrase the word that is looked for first
_SIGNS = {skeleton(max(p.split(), key=len)) for p in ADVERTS if p != "s u b s b y"} | {"b"}


class _Suspects(dict):
    """Whether a token can be part of an advert; remembers the answer for each."""

    limit = 1 << 18

    def __missing__(self, token: str) -> bool:
        if len(self) >= self.limit:
            self.clear()
        answer = skeleton(token) in _SIGNS or "=" in token or "~" in token or ("." in token and bool(_HOST.search(token)))
        self[token] = answer
        return answer


_suspects = _Suspects()


def cues(text: str) -> list[str]:
    """The bodies of a file's cues, without numbers, times and adverts.  Text before the first time is no cue."""
    if "&" in text:
        text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    bodies = []
    parts = text.split("-->")
    last = len(parts) - 1
    for i in range(1, last + 1):
        part = parts[i]
        start = part.find("\n") + 1
        if not start:
            continue
        if i < last:
            # off goes the line with the next cue's start, and the line of its number
            end = part.rfind("\n")
            line = part.rfind("\n", start, end) if end > start else -1
            number = part[line + 1 : end].strip() if line >= 0 else part[start:end].strip() if end > start else ""
            if number and len(number) < 8 and not number.strip("0123456789OoIl"):
                end = max(line, start)
            body = part[start:end]
        else:
            body = part[start:]
        body = body.strip()
        if body:
            bodies.append(body)
    suspicious = {t for t in {*"\n".join(bodies).split()} if _suspects[t]}
    if suspicious:
        bodies = [b for b in bodies if suspicious.isdisjoint(b.split()) or not _ADVERT.search(b)]
    return bodies


def tokens(text: str) -> list[str]:
    """Words and what else stands between spaces; signs of scripts that write no spaces are one word each."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


def spoken(text: str, between: str = "\n\n") -> str:
    """The spoken text: cues without markup, sound descriptions and speakers' names, joined by blank lines."""
    body = between.join(cues(text))
    if "<" in body or "{" in body:
        body = _TAG.sub("", body)
    body = _SOUND.sub(" ", body)
    if ":" in body:
        body = _SPEAKER.sub("", body)
    return body


def is_word(token: str) -> bool:
    return any(c.isalnum() for c in token)
