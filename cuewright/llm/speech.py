"""What transcripts of speech hold besides speech: time stamps, sound notes, fillers, misspelt words."""

from __future__ import annotations

import re

#: Joins the texts of a batch, so that one pass of a pattern serves all of them.
GLUE = "\x01"

#: Words of sound notes in round brackets.
SOUND_WORDS = (
    "applause applaud applaus applausi aplausos applaudissements beifall oklaski bell bells cheer cheering cheers chuckle chuckles "
    "cough coughing coughs crosstalk cross talk door slams slam gelach gelächter heiterkeit inaudible indistinct interruption interruptions "
    "laugh laughing laughs laughter loud music musik musique música musica noise noises on several benches pause phone rings ringing risas "
    "rires risate risos shouting sigh sighs silence śmiech tumult unclear whispering background brouhaha prolonged"
).split()
#: Fillers that are no words otherwise.
FILLERS = ["you know", "i mean", "uhm", "uh", "um", "erm", "hmm", "hm", "ehm", "eh", "euh", "ähm", "äh", "yyy", "eee", "mah", "hã", "hum", "hein"]
#: Fillers that are words too; they count as fillers only before a comma or dots.
DOUBTFUL_FILLERS = ["er", "em", "este", "no", "nou", "ben", "né", "ach"]

TIME_STAMP = re.compile(r"[\[(<]\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\s*[\])>]|(?:(?<=\x01)|^)\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?=\s)")
_sound = "|".join(sorted(SOUND_WORDS, key=len, reverse=True))
SOUND_NOTE = re.compile(rf"\[[^\[\]\x01]*\]|\(\s*(?:(?:{_sound})[\s.!,]*)+\)|\*[^*\x01]+\*|<[^<>\x01]*>|[♪♫🎵🎶]", re.I)
_longest = sorted(FILLERS, key=len, reverse=True)
_first = "".join(sorted({f[0] for f in FILLERS + DOUBTFUL_FILLERS}))  # told from other words by one character first
FILLER = re.compile(
    rf"\b(?=[{_first}])(?:(?:" + "|".join(re.escape(f) for f in _longest) + r")\b(?:\s*(?:,|\.\.\.|…))?|(?:" + "|".join(DOUBTFUL_FILLERS) + r")\b(?=\s*(?:,|\.\.\.|…)))",
    re.I,
)
_NO_WORD = re.compile(r"[^\w\x01]+")
_NO_WORD_OR_NOTE = re.compile(r"[^\w\x01♪]+")
_REPEATED = re.compile(r"\b(\w+)(?: \1\b)+")


def glued(texts: list[str]) -> str:
    joined = GLUE.join(texts)
    if joined.count(GLUE) != len(texts) - 1:
        joined = GLUE.join(t.replace(GLUE, " ") for t in texts)
    return joined


def canonical(texts: list[str]) -> list[str]:
    """What each text says, as lower-case words: no stamps, sound notes, fillers, punctuation.

    A text of nothing else is what it notes (its sounds, else its fillers); it
    is empty only if the text has no letter, digit or note sign.
    """
    if not texts:
        return []
    plain = TIME_STAMP.sub(" ", glued(texts).lower())
    says = _NO_WORD.sub(" ", FILLER.sub(" ", SOUND_NOTE.sub(" ", plain))).split(GLUE)
    out = [s.strip() for s in says]
    bare = [i for i, s in enumerate(out) if not s]
    if bare:
        notes = plain.split(GLUE)
        for i in bare:
            note = _NO_WORD_OR_NOTE.sub(" ", notes[i].replace("🎵", "♪").replace("🎶", "♪").replace("♫", "♪")).strip()
            out[i] = " ".join(dict.fromkeys(note.split())) if "♪" in note else note
    return out


def misspelt(a: str, b: str) -> bool:
    """Whether two words differ by one slip of the pen: two letters swapped, one doubled, missing or too many.

    Numbers never do, nor a word and the same with an s; another letter in
    place of one makes another word.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2 or not (a.isalpha() and b.isalpha()):
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return k + 1 < len(a) and a[k] == b[k + 1] and a[k + 1] == b[k] and a[k + 2 :] == b[k + 2 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if len(short) < 3 or long[k + 1 :] != short[k:]:
        return False
    return not (long == short + "s")


def _both_misspelt(a: str, b: str) -> bool:
    """Whether two long words are each one slip from the same word."""
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    shorter = {a[:i] + a[i + 1 :] for i in range(len(a))}
    swapped = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    longer = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)}
    return any(misspelt(w, b) and misspelt(w, a) for w in shorter | swapped | longer)


def alike(a: str, b: str) -> bool:
    """Whether two canonical texts say the same but for a misspelt word in each and repeated words."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2:
        if len(a) > 12 and len(b) > 12 and a[:4] != b[:4] and a[-4:] != b[-4:]:
            return False
        a, b = _REPEATED.sub(r"\1", a), _REPEATED.sub(r"\1", b)
        if abs(len(a) - len(b)) > 2:
            return a == b
    x, y = a.split(), b.split()
    if len(x) != len(y):
        x, y = _REPEATED.sub(r"\1", a).split(), _REPEATED.sub(r"\1", b).split()
        if len(x) != len(y):
            return False
    other = [(u, v) for u, v in zip(x, y) if u != v]
    if len(other) > 2:
        return False
    return all(misspelt(u, v) for u, v in other) or (len(other) == 1 and len(x) > 2 and _both_misspelt(*other[0]))


_BLANKS = re.compile(r"[^\S\x01]+")


def cleaned(texts: list[str]) -> list[str]:
    """Texts as spoken: without stamps, sound notes and fillers, blanks folded."""
    if not texts:
        return []
    plain = FILLER.sub(" ", SOUND_NOTE.sub(" ", TIME_STAMP.sub(" ", glued(texts))))
    return [t.strip(" ,-–—>") for t in _BLANKS.sub(" ", plain).split(GLUE)]
