"""Places of a text where a sentence may end, with what the language model sees of them.

A site is a run of end marks with the quotes and brackets that close behind it, a
line break without such a mark, a dash that cuts a speech short, or white space
after Thai. Every other gap between two words is one too, and every place beside a sign of Han
or kana: where no mark comes for long the gaps in ``sites``, all others in ``gaps``. Bracketed remarks are passed over: the words before and behind them
meet, so that a remark inside a sentence ends nothing, and one between two sentences
becomes a unit of its own when the site before it ends a sentence.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import regex

#: Punctuation of the scripts covered (fixed values).
CLOSING_OF = {"(": ")", "[": "]", "（": "）", "［": "］", "【": "】"}
QUOTE_CLOSERS = {
    "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』",
}
#: Openers that are something else too often: a closing quote.
NEVER_OPEN = "”"
STRONG = "!?！？。।॥؟۔｡"
OPENERS = "“„«‹「『‘\"'¿¡([（［【"
CLOSERS = "”“»›」』’\"'"

#: What a run without white space may begin and end with beside its words.
_OPENING = OPENERS.replace("¿", "").replace("¡", "")
_CLOSING = CLOSERS + ")]）］】"

_BREAK = r"\r\n\v\f\x85\u2028\u2029"
_SITE = regex.compile(
    rf"(?P<mark>[.…{STRONG};\u037e]+)"
    rf"|(?P<cut>(?<=[\p{{L}}\p{{N}}\p{{M}}])[—–](?=\s))"
    rf"|(?P<line>[^\S{_BREAK}]*[{_BREAK}]\s*)"
    rf"|(?P<thai>(?<=\p{{Thai}})[^\S{_BREAK}]+)"
)
_SPACES = regex.compile(r"\s*")
_CHUNK = re.compile(r"\S+")
#: The end of a word, or one sign of a script without spaces.
_UNIT_END = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|\w+")
_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]"
_WORD = rf"(?!{_CJK})\p{{L}}[\p{{L}}\p{{M}}\u00ad\u200b\u2060]*+(?:['’.\-]\p{{L}}[\p{{L}}\p{{M}}]*)*"
_NEXT = regex.compile(rf"[\s{regex.escape(OPENERS.replace('¿', '').replace('¡', ''))}]*+(?:({_NUMBER}|{_CJK}{{1,2}}|{_WORD})|(\S))")
_LAST_NUMBER = regex.compile(rf"{_NUMBER}$")
_LAST_CJK = regex.compile(rf"{_CJK}{{1,2}}$")
_LAST_WORD = regex.compile(r"(?:\p{L}[\p{L}\p{M}\u00ad\u200b\u2060]*['’.\-])*\p{L}[\p{L}\p{M}\u00ad\u200b\u2060]*$")
_SIGNS = regex.compile(rf"{_CJK}+")
_IS_CJK, _IS_GREEK = regex.compile(_CJK), regex.compile(r"\p{Greek}")
_IS_WORDY = regex.compile(r"[\p{L}\p{N}\p{M}]")
_BREAKS = regex.compile(r"\r\n?|[\n\v\f\x85\u2028\u2029]")
_CAPITALS = regex.compile(r"\P{L}{0,3}\p{Lu}[\p{Lu}\p{M}'’]+\s+[\p{Lu}\p{N}][\p{Lu}\p{M}\p{N}.,'’]*\s+[\p{Lu}\p{N}][\p{Lu}\p{N}]*\P{L}")
_THAI = regex.compile(r"\p{Thai}")
_LABEL = regex.compile(r"[:：]\s*$")

#: Frequent words that tell Latin-script languages apart (fixed values).
_FREQUENT = {
    "en": "the of and to is that was were by at for",
    "de": "der die das und nicht ist wir im am dem den für mit eine ich hat zu",
    "fr": "le les la et de des est du une je ne pas il sur",
    "es": "el los las que y es una se por con del para en",
}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _language, _words in _FREQUENT.items():
    for _word in _words.split():
        _LANGUAGES_OF.setdefault(_word, []).append(_language)
_LAST_LETTER = regex.compile(r"(?r)\p{L}")
_FREQUENT_WORD = regex.compile(r"\b\L<words>\b", words=list(_LANGUAGES_OF))

#: Lines that begin a text and have no mark are as a rule headings or notes while they are
#: few and short; others are more often wrapped. Both are left to the model.
HEADING_LINES, HEADING_CHARS = 4, 90
#: Words, or signs of scripts without spaces, between two marks from which on the text there
#: counts as unpunctuated: then a boundary in a gap between its words is likelier beforehand.
UNMARKED_WORDS = 60
#: The marks of any other gap between two words, and of a place beside a sign of Han or kana
#: without white space.
GAP, SIGN = "_", "^"
#: Characters before a site in which its last token is looked for.
_LOOK_BACK = 48

END = "</s>"
#: Scripts other than Latin in which a number may be followed by a full stop.
SCRIPTS = {
    "han": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    "cyrillic": regex.compile(r"\p{Cyrillic}"),
    "greek": regex.compile(r"\p{Greek}"),
    "arabic": regex.compile(r"\p{Arabic}"),
    "devanagari": regex.compile(r"\p{Devanagari}"),
    "thai": regex.compile(r"\p{Thai}"),
}


@lru_cache(maxsize=100_000)
def shape(token: str) -> str:
    """What kind of token it is, for tokens too rare to be known; kinds stay as they are."""
    if not token or (token[0] == "<" and token[-1] == ">" and len(token) > 1):
        return token
    if not (token[0].isalpha() or token[0].isnumeric()):
        return token[:1]
    if token[0].isnumeric():
        return "0"
    if _IS_CJK.match(token):
        return "<han>"
    letters = [c for c in token if c.isalpha()]
    of = "" if token[0] < "\u0370" else next((":" + n for n, p in SCRIPTS.items() if p.match(token)), "")
    if not (token.lower() != token or token.upper() != token):
        return f"<letters{of}>"
    if len(letters) == 1:
        return f"<X{of}>" if token[0].isupper() else f"<x{of}>"
    if all(c.isupper() for c in letters):
        return f"<XX{of}>"
    dotted = "." if "." in token else ""
    return f"<Xx{dotted}{of}>" if token[0].isupper() else f"<xx{dotted}{of}>"


def is_small(kind: str) -> bool:
    """Whether a kind is that of a word with a small first letter."""
    return kind.startswith("<x")


def _any_of(pairs: dict[str, str]) -> regex.Pattern:
    return regex.compile(f"[{regex.escape(''.join(sorted({*pairs, *''.join(pairs.values())})))}]")


_PAIR_MARKS = {id(p): _any_of(p) for p in (CLOSING_OF, QUOTE_CLOSERS)}


@dataclass(slots=True)
class Site:
    """``at`` ends the unit if the site is a boundary; ``remarks`` are units behind it."""

    at: int
    last: str  # token before
    mark: str  # class of mark
    one: bool  # only that token since the site before
    gap: str  # none, space, line, lines, end
    next: str  # token behind, past remarks
    remarks: list[tuple[int, int]] = field(default_factory=list)
    quote: int = -1  # the quote within which it lies or that it closes
    closes: bool = False
    settled: bool | None = None  # decided by rule

    def key(self) -> tuple[str, str, bool, str, str]:
        return self.last, self.mark, self.one, self.gap, self.next


def spans(text: str, pairs: dict[str, str]) -> list[tuple[int, int]]:
    """Outermost matched pairs as (start, end); what is never closed is no pair."""
    found, stack = [], []
    waiting: dict[str, int] = {}  # openers on the stack by what closes them
    for m in _PAIR_MARKS[id(pairs)].finditer(text):
        c = m.group()
        if waiting.get(c):
            while stack:
                o, at = stack.pop()
                for closer in pairs[o]:
                    waiting[closer] -= 1
                if c in pairs[o]:
                    found.append((at, m.end()))
                    break
        elif c in pairs and c not in NEVER_OPEN:
            stack.append((c, m.start()))
            for closer in pairs[c]:
                waiting[closer] = waiting.get(closer, 0) + 1
    found.sort()
    outer: list[tuple[int, int]] = []
    for s in found:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    return outer


def span_at(of: list[tuple[int, int]], at: int) -> int:
    """Which of the spans holds a place, or -1."""
    k = bisect.bisect_right(of, (at, sys.maxsize)) - 1
    return k if k >= 0 and of[k][0] <= at < of[k][1] else -1


def _last_token(text: str, end: int) -> str:
    word = text[text.rfind(" ", max(0, end - _LOOK_BACK), end) + 1 : end]
    if 0 < len(word) < _LOOK_BACK and word.isalpha() and max(word) < "\u2e80":
        return word
    part = text[max(0, end - _LOOK_BACK) : end].rstrip().rstrip(CLOSERS + ")]）］】").rstrip()
    word = part.rsplit(None, 1)[-1:]
    if word and word[0].isalpha() and word[0] < "\u2e80" and word[0][-1] < "\u2e80":
        return word[0]
    for pattern in (_LAST_NUMBER, _LAST_CJK, _LAST_WORD):
        m = pattern.search(part)
        if m:
            return "0" if pattern is _LAST_NUMBER else m.group()
    return part[-1:]


def _next_token(text: str, at: int) -> str:
    if text.startswith(" ", at):  # as a rule a plain word follows one space
        stop = text.find(" ", at + 1, at + _LOOK_BACK)
        word = text[at + 1 : stop]
        if stop > 0 and word.isalpha() and max(word) < "\u2e80":
            return word
    m = _NEXT.match(text, at)
    if not m:
        return END
    token, other = m.groups()
    if other:
        return other
    if token[0].isnumeric():  # in Han and kana text a number often begins a sentence
        return "0han" if _IS_CJK.match(text, m.end()) else "0"
    return token


def language_near(text: str, at: int) -> str:
    """Script of the letters before a place, or for Latin the language that the
    frequent words around it speak for; '' if there is nothing to tell by."""
    near = _LAST_LETTER.search(text, max(0, at - _LOOK_BACK), at)
    if near and near.group() > "\u036f":
        for name, pattern in SCRIPTS.items():
            if pattern.match(near.group()):
                return name
    for before, behind in ((60, 60), (250, 120)):  # further off only if nothing near speaks
        seen: dict[str, int] = {}
        for w in _FREQUENT_WORD.findall(text[max(0, at - before) : at + behind].lower()):
            for language in _LANGUAGES_OF[w]:
                seen[language] = seen.get(language, 0) + 1
        best = sorted(seen.values())[-2:]
        if best and (len(best) == 1 or best[0] < best[1]):
            break
    return max(sorted(seen), key=seen.__getitem__) if seen else ""


def _mark_class(run: str, greek: bool) -> str | None:
    if any(c in STRONG for c in run):
        return "。" if run[-1] in "。।॥！？؟۔｡" else "!"
    if ";" in run or "\u037e" in run:
        return ";" if greek else None
    if "…" in run or run.count(".") >= 2:
        return "…"
    return "."


def _cased_start(text: str, at: int) -> bool:
    """Whether text goes on with a capitalised word or a script without case."""
    c = text[at : at + 1]
    if not c.isalpha():
        return False
    if c.lower() == c.upper():
        return True
    return c.isupper() and (text[at + 1 : at + 2].islower() or text[at : at + 3].isupper())


def _gap(text: str, end: int, p: int, remarks: list[tuple[int, int]]) -> str:
    """What lies between a site and the text behind it, remarks left out."""
    gap = text[end:p]
    for s, e in remarks:
        gap = gap.replace(text[s:e], " ", 1)
    if p == len(text):
        return "end"
    breaks = 0 if gap in ("", " ") else len(_BREAKS.findall(gap))
    return "lines" if breaks > 1 else "line" if breaks else "space" if gap else "none"


def _remarks_from(text: str, at: int, starts: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Brackets that follow at once, and where the text goes on."""
    got = []
    while True:
        p = _SPACES.match(text, at).end()
        if p not in starts:
            return at, got
        got.append((p, starts[p]))
        at = starts[p]


def sites(text: str) -> tuple[list[Site], list[tuple[int, int]], list[tuple[int, int]]]:
    """A text's sites in order, the quotes, and the remarks before its first word."""
    return _sites(text, spans(text, CLOSING_OF))


def _sites(text: str, brackets: list[tuple[int, int]]) -> tuple[list[Site], list[tuple[int, int]], list[tuple[int, int]]]:
    quotes = spans(text, QUOTE_CLOSERS)
    starts = dict(brackets)

    def labelled(bracket: tuple[int, int], at: int) -> bool:
        """Whether a mark that ends at ``at`` ends a bracket that is all a speaker says."""
        return text[at : bracket[1] - 1].strip() == "" and bool(
            _LABEL.search(text[max(0, bracket[0] - 40) : bracket[0]])
        )

    def introduced(start: int) -> bool:
        """Whether words of the same sentence stand before a quote."""
        for site in reversed(out):
            if site.at <= start:
                behind = max([site.at, *(r[1] for r in site.remarks)])
                return _SPACES.match(text, behind).end() < start
        return _SPACES.match(text).end() < start

    out: list[Site] = []
    begin, opening = _remarks_from(text, 0, starts)
    if _SPACES.match(text, begin).end() == len(text):
        opening = opening if len(opening) > 1 else []
    done = begin if opening else 0  # all before belongs to sites found so far
    straight = counted = 0  # straight quotes up to a place
    lines = 0  # lines so far, all of them headings or notes; else -1
    plain = True  # the line holds no mark but such as in "No. 3"
    line_start = _SPACES.match(text, done).end()
    if opening and begin < len(text):
        gap = text[begin : _SPACES.match(text, begin).end()]
        if gap and not set(gap) & set("\r\n") and _next_token(text, begin)[:1].islower():
            done, opening = 0, []

    for m in _SITE.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        inside = span_at(brackets, a) if brackets else -1
        if inside >= 0 and not (m.lastgroup == "mark" and labelled(brackets[inside], b)):
            continue
        kind = m.lastgroup
        q = span_at(quotes, a) if quotes else -1
        closes, quoted = False, ""
        settled: bool | None = None
        if kind == "mark":
            run = m.group()
            if run == ".":
                # most full stops within numbers and abbreviations go here
                if text[b : b + 1].isalnum() and not _cased_start(text, b):
                    continue
                mark, last = ".", _last_token(text, a)
                if last == "0":  # whether it is an ordinal hangs on the language
                    last = "0" + language_near(text, a)
            elif run == ";" and text[max(0, a - 1) : a] < "\u0370":
                continue
            else:
                last = _last_token(text, a)
                mark = _mark_class(run, bool(_IS_GREEK.match(last)))
                if mark is None:
                    continue
            end = b if inside < 0 else brackets[inside][1]
            if q >= 0:
                p = _SPACES.match(text, b).end()
                if p == quotes[q][1] - 1:
                    end, closes = p + 1, True
                    quoted = "Q1" if introduced(quotes[q][0]) else "Q0"
            if text[end : end + 1] == '"' and not closes:
                straight += text.count('"', counted, end)
                counted = end
                end += straight % 2  # it closes a quote
            after = text[end : end + 1]
            if mark == "." and end == b:
                if after.isalnum() and not (
                    _cased_start(text, end) and len(last) > 1 and (a and not text[a - 1].isnumeric() or after.isupper())
                ):
                    continue
                if after.isalnum() and a and text[a - 1].isalpha() and len(last.rsplit(".", 1)[-1]) < 2 and "." not in last:
                    continue
            if after in "/\\@_" and after:
                continue
        elif kind == "cut":
            last, mark, end = _last_token(text, a), "—", b
        elif kind == "line":
            if q >= 0:
                continue
            last, end = _last_token(text, a), a
            tail = text[max(0, a - 1) : a]
            if starts.get(line_start) == a:
                mark = "\nR"
            elif tail in "—–" and tail:
                mark = "\nD"
            elif 0 <= lines < HEADING_LINES and plain and a - line_start <= HEADING_CHARS:
                mark = "\nH"
            else:  # a long first line, or one behind marks
                mark = "\nL" if 0 <= lines and plain else "\nW"
            if end <= done:
                line_start = b
                continue
        else:
            if q >= 0:
                continue
            last, mark, end = _thai_end(text, a), "thai", a
        alone = last.rstrip("abcdefghijklmnopqrstuvwxyz") if last[:1] == "0" else last
        if text.startswith(" ", end) and text[end + 1 : end + 2] > " " and end + 1 not in starts:
            go, remarks, p, gap = end, [], end + 1, "space"
        else:
            go, remarks = _remarks_from(text, end, starts)
            p = _SPACES.match(text, go).end()
            gap = _gap(text, end, p, remarks)
        nxt = _next_token(text, go)
        if len(nxt) > 1 and nxt.isupper():  # within a text in capitals
            if len(last) > 2 and last.isupper():
                last, nxt = last.lower(), nxt.capitalize()
            elif last[:1] == "0" and mark != "." or _CAPITALS.match(text, p):
                nxt = nxt.capitalize()
        if mark in ("\nH", "\nL") and (nxt[:1].islower() or not _IS_WORDY.match(last[-1:])):
            settled = False
        if mark == "—":
            settled = shape(nxt) not in ("0", "–", ",", ";") and not is_small(shape(nxt))
        if kind == "thai" or (mark in ("\nW", "\nH", "\nL") and _THAI.match(text, max(0, end - 1))):
            last, mark, settled = _thai_end(text, end), "thai", None
            nxt = "0" if text[p : p + 1].isnumeric() else nxt
        if kind == "line" and _LABEL.search(text[max(0, end - 40) : end]):
            settled = False
        if gap == "end":
            settled = True
        one = bool(out) and a - out[-1].at <= len(last) + 8 and text[out[-1].at : a].strip(CLOSERS + OPENERS + " \t\r\n\xa0") == alone
        site = Site(end, last, mark + quoted, one, gap, nxt, remarks, q, closes, settled)
        out.append(site)
        done = go if remarks else end
        if not (nxt[:1] == "0" and mark in (".", "thai")) and kind != "line":
            plain = False
        if kind == "line" or gap in ("line", "lines"):
            line_start = p
            lines = lines + 1 if lines >= 0 and mark in ("\nH", "\nR") else -1
            plain = True
    return _with_gaps(text, out, brackets, quotes), quotes, opening


def _thai_end(text: str, at: int) -> str:
    """What stands before white space after Thai: a numeral, a speaker's label or a word."""
    if text[max(0, at - 1) : at].isnumeric():
        return "<0:thai>"
    return "<label:thai>" if _LABEL.search(text[max(0, at - 40) : at]) else "<end:thai>"


def _with_gaps(text: str, found: list[Site], brackets: list, quotes: list) -> list[Site]:
    """The sites, and the gaps between words of stretches without any mark."""
    out, begin = [], 0
    for site in [*found, None]:
        end = site.at if site else len(text)
        # no stretch of so many words is shorter than that
        if end - begin > UNMARKED_WORDS and (text.count(" ", begin, end) > UNMARKED_WORDS or _IS_CJK.search(text, begin, end)):
            words = [m.end() for m in _UNIT_END.finditer(text, begin, end)]
            for a in words if len(words) > UNMARKED_WORDS else ():
                if a >= end or not text[a].isspace() or span_at(brackets, a) >= 0 or span_at(quotes, a) >= 0:
                    continue
                p = _SPACES.match(text, a).end()
                if p < end and text[p].isalnum() and not _BREAKS.search(text, a, p):
                    out.append(Site(a, _last_token(text, a), " ", False, "space", _next_token(text, a)))
        if site:
            out.append(site)
            begin = max([site.at, *(r[1] for r in site.remarks)])
    return out


@lru_cache(maxsize=200_000)
def _ends_of(chunk: str) -> tuple[str | None, str | None]:
    """By which tokens a run without white space begins and ends; None where a mark stands,
    '' where the text around has to tell: at what opens or closes."""
    first = chunk[0]
    if first in _OPENING:
        head = ""
    elif first == "’" and len(chunk) > 1:  # of a word that lacks its first letters
        head = _ends_of(chunk[1:])[0]
    else:
        head = _next_token(chunk, 0) if _is_word(first) or first in "¿¡" else None
    bare = chunk.rstrip(_CLOSING)
    if not bare:
        return head, ""
    return head, _last_token(chunk, len(chunk)) if _is_word(bare[-1]) else None


def _is_word(c: str) -> bool:
    """Whether a character belongs to a word, number or unit."""
    return c.isalnum() or c in "%‰" or unicodedata.category(c)[0] != "P"


def gaps(
    text: str, found: list[Site], brackets: list[tuple[int, int]], quotes: list[tuple[int, int]], opening: list[tuple[int, int]]
) -> tuple[str, list[int], list[Site]]:
    """All gaps between words, and places beside signs, that are no sites yet, in two forms.

    Plain ones are a string of tokens parted by one space, in which each two that follow one
    another are those around a gap and an empty one parts others, with the characters from gap
    to gap and those of each gap. The first token of a place without white space has SIGN before
    it. Gaps before a quote or a remark are sites. Within brackets
    nothing ends, and a mark that ends nothing, such as a comma, goes on with its sentence.
    """
    taken = {s.at for s in found} | {r[1] for s in found for r in s.remarks} | {r[1] for r in opening}
    starts, closed = dict(brackets), {e for _, e in quotes}
    straight = [i for i, c in enumerate(text) if c == '"'] if '"' in text else []
    words: list[str] = []
    steps: list[int] = []
    more: list[Site] = []
    cursor, tail, a, joined = 0, None, 0, None
    for m in _CHUNK.finditer(text):
        p, b = m.span()
        chunk = m.group()
        head, then = _ends_of(chunk)
        if tail is None or head is None or a in taken or (brackets and span_at(brackets, a) >= 0):
            joined = None
        elif text[a:p] != " " and _BREAKS.search(text, a, p) and span_at(quotes, a) < 0:
            joined = None
        elif tail == "" and not (token := _before_closers(text, a, straight, closed)):
            joined = None
        else:
            if tail == "":
                tail, joined = token, None
            if head:
                if joined != tail:
                    words += ("", tail) if words else (tail,)
                words.append(head)
                steps += (a - cursor, p - a)
                cursor, joined = p, head
            else:
                joined = None
                site = _gap_site(text, a, p, tail, starts, straight, closed)
                if site:
                    site.quote = span_at(quotes, a)
                    more.append(site)
                    taken.update(r[1] for r in site.remarks)
        if not chunk.isascii():
            for at, last, nxt in _beside_signs(chunk):
                if not brackets or span_at(brackets, p + at) < 0:
                    words += ("", SIGN + last, nxt) if words else (SIGN + last, nxt)
                    steps += (p + at - cursor, 0)
                    cursor, joined = p + at, None
        tail, a = then, b
    return " ".join(words), steps, more


def _beside_signs(chunk: str) -> Iterator[tuple[int, str, str]]:
    """Places between a sign of Han or kana and another or a word, with the tokens around."""
    n = len(chunk)
    for m in _SIGNS.finditer(chunk):
        s, e = m.span()
        if s and chunk[s - 1].isalnum():
            yield s, _last_token(chunk, s), _next_token(chunk, s)
        for i in range(s + 1, e):
            yield i, chunk[max(s, i - 2) : i], chunk[i : min(e, i + 2)]
        if e < n and chunk[e].isalnum() and not _IS_CJK.match(chunk, e):
            yield e, chunk[max(s, e - 2) : e], _next_token(chunk, e)


def _before_closers(text: str, at: int, straight: list[int], closed: set[int]) -> str:
    """The token before quotes or brackets that stand by themselves and close; '' if they open or a mark is before."""
    c = text[at - 1]
    if c == "'" or c == '"' and bisect.bisect_left(straight, at) % 2 or c in QUOTE_CLOSERS and at not in closed:
        return ""
    part = text[max(0, at - _LOOK_BACK) : at].rstrip(_CLOSING + " \t\xa0")
    return _last_token(part, len(part)) if part and _is_word(part[-1]) else ""


def _gap_site(text: str, a: int, p: int, last: str, starts: dict[int, int], straight: list[int], closed: set[int]) -> Site | None:
    """The gap before what opens, unless it closes something or a mark follows."""
    go, remarks = _remarks_from(text, a, starts)
    p = _SPACES.match(text, go).end()
    c = text[p : p + 1]
    if c == '"' and bisect.bisect_left(straight, p) % 2 or c in QUOTE_CLOSERS and p + 1 in closed:
        return None
    nxt = _next_token(text, go)
    if nxt == END or not (_is_word(nxt[0]) or nxt in "¿¡"):
        return None
    return Site(a, last, GAP, False, "quote" if c in _OPENING else "space", nxt, remarks)


def sites_and_gaps(text: str) -> tuple[list[Site], list[tuple[int, int]], list[tuple[int, int]], str, list[int]]:
    """Sites, quotes and remarks as by ``sites``, and all other gaps as by ``gaps``."""
    brackets = spans(text, CLOSING_OF)
    found, quotes, opening = _sites(text, brackets)
    words, steps, more = gaps(text, found, brackets, quotes, opening)
    if more:
        found = sorted([*found, *more], key=lambda s: s.at)
    return found, quotes, opening, words, steps
