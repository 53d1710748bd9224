"""Visually identical text with different characters: one consistent form.

``fold`` removes invisible characters, turns other blanks into spaces, full- and half-width forms into plain ones,
composes accents, voicing marks and jamo, and gives each word one script. The script set of a letter is the scripts that
it has itself; a word whose sets intersect is in one script. Where they don't, each set is widened by the scripts of the
letter's look-alikes, the widened sets are intersected, and the look-alikes of the script that fits best are taken. A
word wholly in look-alikes of another script is replaced where the corpus knows the other spelling far better
(``lookalike.whole_words``). Letters of scripts without case that stand in one token with others, as Chinese or Japanese
do, form words of their own.

Look-alikes are those of :class:`Shapes`: the pairs below, and, from :func:`shapes`, all classes of the public confusables
data that the session's Unicode library holds.

Results for odd input: null stays null, empty stays empty; carriage returns, line feeds, emoji with their joiners and
selectors, and symbols stay; words whose foreign letters have no look-alike stay; a tie between two scripts goes to the
one with more letters that only it has, then more letters, then Latin.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud

#: Look-alike letters, as pairs of a letter and its Latin image.
CYRILLIC = "аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs уy хx ѵv ԝw ѐè ёë їï ӓä ӧö АA ВB СC ԌG ЕE НH ІI ЈJ КK Ӏl МM ОO РP ԚQ ЅS ТT ѴV ԜW ХX УY ҮY ЇÏ ЁË ЀÈ ӒÄ ӦÖ"
GREEK = "αa οo νv ρp ιi κk υu τt χx γy ϲc ϳj έé όó ίí άá ϊï ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC"
ARMENIAN = "օo սu հh ցg զq ոn աw յj Օo Տs Լl"
_TO_LATIN = {n: {p[0]: p[1] for p in t.split()} for n, t in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("ARMENIAN", ARMENIAN))}
#: Letters that everyday Cyrillic lacks: they pass for Latin ones, but nobody means them in place of Latin ones.
_RARE = set("ԁһіјӏԛѕѵԝѐїӓӧԌІЈӀԚЅѴԜҮЇЀӒӦ")
#: Scripts that a word may be brought to, and their everyday letters.
_TARGETS = {"LATIN": re.compile("[A-Za-z]"), "CYRILLIC": re.compile("[\u0410-\u044f\u0401\u0451]"), "GREEK": re.compile("[\u0391-\u03a9\u03b1-\u03c9]")}


@functools.cache
def scripts(c: str) -> frozenset[str]:
    """The scripts of a letter, as its name gives them; none for letters of no script, such as mathematical ones."""
    name = ud.name(c, "")
    if name.startswith("KATAKANA-HIRAGANA"):
        return frozenset(("KATAKANA", "HIRAGANA"))
    first, _, rest = name.partition(" ")
    known = re.search("LETTER|SYLLAB|IDEOGRAPH|LIGATURE|SIGMA|SYMBOL", rest) and first not in ("MATHEMATICAL", "FULLWIDTH", "HALFWIDTH", "MODIFIER")
    return frozenset((first,)) if known else frozenset()


#: Words whose form a table of shapes remembers.
REMEMBERED = 100_000


class Shapes:
    """Letters and their look-alikes by script; ``classes`` are further groups of letters that look the same."""

    def __init__(self, classes: list[str] = ()):
        self.image: dict[str, dict[str, str]] = {}
        self.seen: dict[str, str] = {}
        for script, pairs in _TO_LATIN.items():
            for a, b in pairs.items():
                self._add(a, "LATIN", b)
                if script in _TARGETS and a not in _RARE:
                    self._add(b, script, a)
        for script, other in (("CYRILLIC", "GREEK"), ("GREEK", "CYRILLIC")):
            for a, b in _TO_LATIN[script].items():
                if (c := self.image.get(b, {}).get(other)) is not None:
                    self._add(a, other, c)
        for group in classes:
            for target, usual in _TARGETS.items():
                ends = [c for c in group if usual.match(c) and c not in _RARE]
                for c in group:
                    same = [e for e in ends if e.isupper() == c.isupper() and e.islower() == c.islower()] or ([] if c.isupper() or c.islower() else [e for e in ends if e.islower()])
                    if same and scripts(c) and target not in scripts(c):
                        self._add(c, target, same[0])
                    elif same and target == "LATIN" and "\u0250" <= c <= "\u02af":
                        self._add(c, "PLAIN", same[0])  # a phonetic letter for a plain one

    def _add(self, c: str, script: str, image: str) -> None:
        self.image.setdefault(c, {}).setdefault(script, image)

    def one_script(self, word: str) -> str:
        """:meth:`_one_script`, remembered for short words."""
        form = self.seen.get(word)
        if form is None:
            form = self._one_script(word)
            if len(word) <= 40:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = form
        return form

    def _one_script(self, word: str) -> str:
        """The word with its look-alikes in the script that all its letters can have; itself if it has one script or if
        there is none."""
        letters = [c for c in word if ud.category(c)[0] == "L"]
        letters = [c for c in letters if scripts(c)]  # those of no script go with any
        own = [scripts(c) for c in letters]
        if not letters or frozenset.intersection(*own):
            return self._plain(word)
        wide = [frozenset(o | self.image.get(c, {}).keys()) for c, o in zip(letters, own)]
        best = None
        for target in sorted(frozenset.intersection(*wide) & frozenset().union(*own)):
            here = [c for c, o in zip(letters, own) if target in o]
            only = sum(1 for c in here if not any(s in self.image.get(c, ()) for o in own for s in o if s != target))
            score = (only, len(here), target == "LATIN")
            if best is None or score > best[0]:
                best = (score, "".join(self.image[c][target] if ud.category(c)[0] == "L" and scripts(c) and target not in scripts(c) else c for c in word))
        return self._plain(best[1]) if best else word

    def _plain(self, word: str) -> str:
        """Phonetic letters of a Latin word that are used as plain ones."""
        if word.isascii() or not _PHONETIC.search(word) or _PHONETIC.sub("", word).isascii() is False:
            return word
        if len(_PHONETIC.findall(word)) * 2 > len(word):  # mostly phonetic: a transcription
            return word
        return _PHONETIC.sub(lambda m: self.image.get(m[0], {}).get("PLAIN", m[0]), word)

    def whole_image(self, word: str) -> str | None:
        """The Latin image of a word wholly in the look-alikes of one other script, or None."""
        if not word or "LATIN" not in self.image.get(word[0], ()) or not (common := frozenset.intersection(*map(scripts, word))) or "LATIN" in common:
            return None
        out = [self.image.get(c, {}).get("LATIN") for c in word]
        return None if None in out else "".join(out)


#: The pairs above alone.
BASE = Shapes()


def shapes(spark) -> Shapes:
    """All look-alike letters of the public confusables data, as the Unicode library of the session's JVM gives them."""
    letters = [chr(c) for c in range(0x41, 0x20000) if ud.category(chr(c))[0] == "L" and ud.bidirectional(chr(c)) == "L" and not _CJK.match(chr(c))]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    groups: dict[str, list[str]] = {}
    for c, form in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        groups.setdefault(form, []).append(c)
    return Shapes(["".join(g) for g in groups.values() if len(g) > 1])


_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]")
_BLANK = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WIDE = re.compile("[\uff01-\uff9f\uffa1-\uffef]+")
#: Anything that may need work: a text without these is its own form.
SIGNS = re.compile("[\u00a0\u00ad\u0250-\u02af\u0300-\u052f\u0530-\u058f\u0591-\u065f\u0670-\u0711\u0900-\u1fff\u2000-\u200f\u2028-\u202f\u205f-\u206f\u20d0-\u20ff\u2100-\u2188\u2c00-\u2dff\u3000\u302a-\u302f\u3099-\u309c\u3130-\u318f\ua4d0-\ua4ff\ua640-\ua69f\uab30-\uabbf\ufb00-\ufb06\ufe00-\ufe0f\ufe20-\ufe2f\ufeff-\uffef\ufff9-\ufffb\U00010000-\U0010ffff]")
_CJK = re.compile("[\u1100-\u11ff\u3005\u3040-\u318f\u31a0-\u31ff\u3400-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff]")
_WORD = re.compile("(?:(?![\u1100-\u11ff\u3005\u3040-\u318f\u31a0-\u31ff\u3400-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff])[^\\W\\d_]|(?<=\\w)[\u0300-\u036f])+")
_STYLED = re.compile("[\u2100-\u2188\ufb00-\ufb06\U0001d400-\U0001d7ff\U0001ee00-\U0001eeff]")
_PHONETIC = re.compile("[\u0250-\u02af]")
#: Letters that may be look-alikes of others: all alphabets but the plain Latin one.
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f\u0d00-\u0d7f\u1000-\u10ff\u13a0-\u1aff\u1c80-\u1c8f\u1d00-\u1dbf\u1f00-\u1fff\u2c00-\u2dff\ua4d0-\ua4ff\ua500-\ua69f\uab30-\uabbf\U00010000-\U0001ffff]")
_KANA_MARK = re.compile("([\u3041-\u30ff])([\u309b\u309c])")


def _pictograph(c: str) -> bool:
    return ud.category(c) in ("So", "Sk", "Sm") or 0x1F000 <= ord(c) <= 0x1FAFF or c in "\u203c\u2049"


def _joins(text: str, k: int) -> bool:
    """Whether the invisible character at k belongs to an emoji or to a script that joins its letters."""
    c = text[k]
    before = text[k - 1] if k else ""
    if "\ufe00" <= c <= "\ufe0f":
        return bool(before) and (_pictograph(before) or (before in "#*0123456789" and c == "\ufe0f" and text[k + 1 : k + 2] == "\u20e3"))
    if "\U000e0020" <= c <= "\U000e007f":
        return bool(before) and (before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007e")
    if c in "\u200c\u200d":
        j = k - 1
        while j >= 0 and ("\ufe00" <= text[j] <= "\ufe0f" or 0x1F3FB <= ord(text[j]) <= 0x1F3FF):
            j -= 1
        left, right = text[j] if j >= 0 else "", text[k + 1 : k + 2]
        if c == "\u200d" and left and right and _pictograph(left) and _pictograph(right):
            return True
        cursive = lambda x: x and ("\u0600" <= x <= "\u08ff" or "\u0900" <= x <= "\u0dff" or "\u1000" <= x <= "\u109f" or "\u1780" <= x <= "\u17ff" or "\u1800" <= x <= "\u18af")
        return bool(cursive(left) and (not right or cursive(right)))
    return False


def whole_image(word: str) -> str | None:
    """The Latin image of a word of three letters and more wholly in Cyrillic or Greek look-alikes, or None."""
    return BASE.whole_image(word) if len(word) >= 3 and not scripts(word[0]).isdisjoint(("CYRILLIC", "GREEK")) else None


@functools.cache
def _plain_letters(c: str) -> str:
    """What a letter in another style, a ligature or a letter-like number is written with; symbols stay."""
    kind = ud.decomposition(c)
    if (kind.startswith("<font>") and ud.category(c)[0] == "L") or (kind.startswith("<compat>") and (ud.category(c) == "Nl" or "\ufb00" <= c <= "\ufb06")):
        return ud.normalize("NFKC", c)
    return c


def plain(text: str, styles: bool = False) -> tuple[str, set[str]]:
    """The form before scripts, and what was changed: invisible, blank, width, marks, and with ``styles`` style."""
    why: set[str] = set()
    if styles and _STYLED.search(text):
        plainer = _STYLED.sub(lambda m: _plain_letters(m[0]), text)
        if plainer != text:
            why.add("style")
            text = plainer
    if _INVISIBLE.search(text):
        kept = [c for k, c in enumerate(text) if not _INVISIBLE.match(c) or _joins(text, k)]
        if len(kept) < len(text):
            why.add("invisible")
            text = "".join(kept)
    if _BLANK.search(text):
        if "\u3000" in text:
            why.add("width")
        why.add("blank")
        text = _BLANK.sub(" ", text)
    if _WIDE.search(text):
        wide = _WIDE.sub(lambda m: ud.normalize("NFKC", m[0]), text)
        if wide != text:
            why.add("width")
            text = wide
    if "\u309b" in text or "\u309c" in text:
        text2 = _KANA_MARK.sub(lambda m: c if len(c := ud.normalize("NFC", m[1] + ("\u3099" if m[2] == "\u309b" else "\u309a"))) == 1 else m[0], text)
        if text2 != text:
            why.add("marks")
            text = text2
    composed = ud.normalize("NFC", text)
    if composed != text:
        if len(composed) < len(text):
            why.add("marks")
        text = composed
    return text, why


def fold(text: str | None, known: Shapes = BASE, styles: bool = False) -> tuple[str | None, list[str]]:
    """The one form of a text, and the sorted kinds of what was changed."""
    if not text or not SIGNS.search(text):
        return text, []
    text, why = plain(text, styles)
    if _FOREIGN.search(text):
        def word(m: re.Match) -> str:
            w = m[0]
            if not _FOREIGN.search(w):
                return w
            v = known.one_script(w)
            if v != w:
                why.add("script")
            return v

        text = ud.normalize("NFC", _WORD.sub(word, text))
    return text, sorted(why)
