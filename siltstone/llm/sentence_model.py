"""A hidden-event language model of sentence boundaries, estimated without labels.

Between the token before a site and the token behind it stands a hidden event:
boundary or none. The words and the boundaries form one n-gram: a word behind a boundary
is drawn from the words that begin sentences, any other from the words that follow the
word before it, by bigrams that back off to its script. The bigrams are counted where
no mark stands between two words and so no boundary can; how sentences begin, how likely
a boundary is after a word and mark, and which white space comes with it is estimated by
expectation and maximisation over the counts of all sites of the corpus, from a plain
first guess. Abbreviations are told by the same counts: they hardly ever stand without
their mark. Decoding runs forward and backward over a text's sites, whose events meet
where a single token stands between them. A gap between two words meets no other event:
its words alone decide it, the last by how often a sentence ends with it and how often it
goes on without a mark.

The counts that the model keeps are bounded whatever the corpus: a token is known by
itself if it makes up at least 1/KNOWN of its script's sites, else by its shape. A row
below 1/KNOWN_ROWS of its script's sites is added to that of the next token's shape, if
that is too small to that of both shapes, and at last to that of both scripts, so that
every site is counted at every size. By these bounds the tables are small enough for the
driver and a broadcast.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

from siltstone.llm.sentence_sites import END, GAP, SCRIPTS, SIGN, is_small, shape

#: Tokens, and combinations of them, that can each have the least share of a script's sites.
KNOWN, KNOWN_ROWS = 20_000, 200_000
#: Sites by which a token of a small script is known, where all sites would ask for more.
LEAST_KNOWN = 10
ROUNDS = 5

#: First guess that a mark is a boundary, before anything has been counted.
GUESS = {
    ".": 0.85, "!": 0.97, "。": 0.98, "…": 0.08, ";": 0.95, "—": 0.7,
    "\nH": 0.6, "\nR": 0.97, "\nD": 0.97, "\nL": 0.02, "\nW": 0.01, "thai": 0.9, " ": 0.05, GAP: 0.002, SIGN: 0.0002,
} | {m + q: p for m in ".!。…;" for q, p in (("Q0", 0.4), ("Q1", 0.8))}
#: Sites that the first guess of a mark weighs against the counts of a token before it.
_ANCHOR = 6.0

#: Marks that as a rule go on with a sentence, and that open one (fixed values).
CONTINUING = (",", ";", ":", "–", "—", "-", ".", "%", ")", "…", "!", "?", "،", "、", "，")
OPENING = ("¿", "¡")

#: Sites that evidence on a token weighs.
_SEED = 12.0
#: How often a mark follows an abbreviation and another word, how rare abbreviations are
#: among words, and how much rarer with each letter, as logarithms of odds. From the fourth
#: letter on it takes some 80 sites more to tell one from a word that only ends sentences.
_MARKED, _OTHERS, _RARE, _LETTER, _LONG = 0.97, 0.08, -5.3, 1.0, 200.0
#: The most that one word behind a mark tells, likewise.
_FOLLOWER = 4.0
#: The share of sentences that lack their mark, before anything has been counted, and sentences that this weighs.
_UNMARKED, _MARKS = 0.001, 1_000
#: Pairs that count as evidence of a word's own followers next to those of its script.
_OWN = 100


def known_key(key: tuple, before: set[str], behind: set[str]) -> tuple:
    """A site's key with rare tokens replaced by their shapes."""
    last, mark, one, gap, nxt = key
    return (
        last if last in before else shape(last), mark, one, gap,
        nxt if nxt in behind else shape(nxt),
    )


def coarser(last: str, nxt: str) -> tuple[str, str, str, str, str]:
    """Script of a row; its tokens' shapes; what is left of both where those are too rare.

    The last keeps a token's script, whether the next is a small word, and the marks
    that the first guess tells apart.
    """
    def of(token: str, small: str) -> str:
        name = script(token)
        return f"<{small}any>" if name == "latin" else f"<{small}any:{name}>"

    kind, own = shape(nxt), script(last)
    if nxt == END or kind in CONTINUING or kind in OPENING:
        rest = kind
    elif kind[:1] == "<" and len(kind) > 1 or kind == "0":
        rest = of(nxt, "x" * is_small(kind))
    else:  # another mark is no word of another script
        rest = of(last, "")
    return own, shape(last), kind, of(last, ""), rest


def first_guess(key: tuple, abbreviated: float = 0.0) -> float:
    """A site's probability before anything is estimated, given that of its token to be an abbreviation."""
    last, mark, one, gap, nxt = key
    p = GUESS[mark]
    odds = p / (1 - p)
    if nxt == END:
        return 1.0
    kind = shape(nxt)
    if kind in CONTINUING:
        odds *= 0.002
    elif kind == "0":
        odds *= 0.01 if mark == "thai" else 0.4
    elif is_small(kind):
        odds *= 0.02
    elif kind in OPENING:
        odds *= 30
    if mark[0] != "\n":
        odds *= {"line": 4, "lines": 40}.get(gap, 1)
        odds *= 0.05 ** abbreviated
        if last in ("<0:thai>", "<label:thai>"):
            odds *= 0.01
        elif is_initial(last) and mark == ".":
            odds *= 0.03
        elif shape(last) == "0" and mark == ".":
            odds *= 0.1
    return odds / (1 + odds)


@lru_cache(maxsize=100_000)
def script(token: str) -> str:
    """Script of a token; marks and plain digits count as Latin."""
    if token[:1] == "0" and token[1:] in SCRIPTS:
        return token[1:]
    if token == "<han>":
        return "han"
    if token[:1] == "<" and ":" in token:
        return token[1:-1].split(":")[1]
    for name, pattern in SCRIPTS.items():
        if pattern.search(token):
            return name
    return "latin"


@lru_cache(maxsize=100_000)
def is_initial(token: str) -> bool:
    """Whether a token is one capital letter."""
    return shape(token)[:2] == "<X" and shape(token)[2] in ":>"


@lru_cache(maxsize=100_000)
def other_script(last: str, nxt: str) -> bool:
    """Whether a word of another script follows."""
    return (nxt[0].isalpha() or (nxt[0] == "<" and len(nxt) > 1)) and script(last) != script(nxt)


def _mixed(counts: dict, of: tuple, nxt: str, wider: float) -> float:
    """Share of a token among the counts of a context, mixed with a wider estimate."""
    total = counts.get(of, 0.0)
    if not total:
        return wider
    weight = max(0.1, 100 / (total + 100))
    return (1 - weight) * counts.get((*of, nxt), 0.0) / total + weight * wider


def _followers(pairs: list[tuple[str, str, float]]) -> dict[tuple, float]:
    """Counts of what follows a token, its script and its kind."""
    counts: dict[tuple, float] = defaultdict(float)
    for last, nxt, n in pairs:
        for at in ((last,), (script(last), ""), (shape(last), "kind")):
            counts[(*at, nxt)] += n
            counts[at] += n
    return dict(counts)


class _Around(dict):
    """Whether a boundary stands in the gap between two words, as far as asked for lately."""

    def __init__(self, model: HiddenEventModel):
        self.model = model
        self._known: dict[tuple, bool] = {}

    def __missing__(self, pair: tuple[str, str]) -> bool:
        model = self.model
        last, mark, gap = pair[0], GAP, "space"
        if last[0] == SIGN and len(last) > 1:
            last, mark, gap = last[1:], SIGN, "none"
        key = known_key((last, mark, False, gap, pair[1]), model.before, model.behind)
        for recent in (self, self._known):
            if len(recent) > 200_000:
                recent.clear()
        got = self._known.get(key)
        if got is None:
            got = self._known[key] = model.posterior(key) > 0.5
        self[pair] = got
        return got

    def __reduce__(self):
        return _Around, (self.model,)


class HiddenEventModel:
    """Tables of counts and the probabilities read from them."""

    def __init__(self, before: set[str], behind: set[str]):
        self.before, self.behind = before, behind
        self._recent: dict[tuple, tuple] = {}
        self.event: dict[tuple, list[float]] = {}
        self.gaps: dict[tuple, float] = {}
        self.start: dict[tuple, float] = {}
        self.cont: dict[tuple, float] = {}
        self.start_shape: dict[str, float] = {}
        self.cont_shape: dict[str, float] = {}
        self.token: dict[str, float] = {}
        self.kind: dict[str, float] = {}
        self.pairs: dict[tuple, float] = {}
        self.abbreviated: dict[str, float] = {}
        self.signs: dict[tuple, float] = {}
        self.apart: dict[tuple, float] = {}
        self.ended: dict[str, float] = {}
        self.unmarked = _UNMARKED
        self.around = _Around(self)

    def learn_pairs(self, pairs: list[tuple[str, str, float]], rows: list[tuple[tuple, float]]) -> None:
        """Take over counts of words that follow one another, and tell abbreviations by them."""
        self.pairs = counts = _followers(pairs)
        starts, within = defaultdict(float), defaultdict(float)
        begun = ((script(key[0]), key[4], n) for key, n in rows if key[1] in ("!", "。") and key[4] != END)
        for of, to in ((begun, starts), (((script(a), b, n) for a, b, n in pairs), within)):
            for name, nxt, n in of:
                to[name, nxt] += n
                to[name] += n
        odds: dict[str, float] = {}
        for (last, mark, _, _, nxt), n in rows:
            if mark[0] == "." and shape(last) != last:  # a known word
                if last not in odds:
                    bare = counts.get((last,), 0.0)
                    odds[last] = _RARE - _LETTER * len(last) - _LONG * max(0, len(last.split(".")[-1]) - 3) + bare * math.log((1 - _MARKED) / (1 - _OTHERS))
                odds[last] += n * math.log(_MARKED / _OTHERS)
                # words that begin sentences speak against it, those that stand within for it
                if shape(nxt) != nxt and not is_initial(nxt):
                    of = script(last)
                    # half a word of the smaller sample: a word seen in neither place tells nothing
                    totals = [t.get(of, 0.0) + 1 for t in (within, starts)]
                    least = 0.5 / min(totals)
                    shares = [t.get((of, nxt), 0.0) / n_all + least for t, n_all in zip((within, starts), totals)]
                    evidence = math.log(shares[0] / shares[1])
                    odds[last] += n * min(max(evidence, -_FOLLOWER), _FOLLOWER)
        self.abbreviated = {t: 1 / (1 + math.exp(min(50.0, max(-50.0, -x)))) for t, x in odds.items()}

    def count(self, rows: list[tuple[tuple, float]], posterior: list[float]) -> None:
        """Replace all tables by the expected counts of ``rows``."""
        event: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        start, cont, start_shape, cont_shape, tokens, kinds, gaps = (
            defaultdict(float) for _ in range(7)
        )
        for (key, n), p in zip(rows, posterior):
            last, mark, one, gap, nxt = key
            yes, no = n * p, n * (1 - p)
            if nxt == END:  # the text is over whatever the mark: this tells nothing
                continue
            for at in ((last, mark, one), (last, mark)):
                event[at][0] += yes
                event[at][1] += no
            if mark[0] == "\n":
                continue
            of = script(last)
            kind = shape(nxt)
            for at in ((of,), ("",)):
                start[(*at, nxt)] += yes
                start[at] += yes
            for at in ((mark[0], of), ()):
                cont[(*at, nxt)] += no
                cont[at] += no
            for at in (kind, ""):
                start_shape[at] += yes
                cont_shape[at] += no
            tokens[nxt] += n
            kinds[kind] += n
            for at, n_event in ((True, yes), (False, no)):
                gaps[at, gap] += n_event
                gaps[(at,)] += n_event
        self._recent = {}
        self.event, self.gaps, self.start, self.cont = dict(event), dict(gaps), dict(start), dict(cont)
        self.start_shape, self.cont_shape = dict(start_shape), dict(cont_shape)
        self.token, self.kind = dict(tokens), dict(kinds)

    def learn_gaps(
        self, pairs: list[tuple[str, str, float]], signs: list[tuple[str, str, float]],
        apart: list[tuple[str, str, float]], rounds: int,
    ) -> None:
        """Estimate how likely a boundary is where no mark stands, in a gap between two words and
        beside a sign of Han or kana; all else stays as it is."""
        self.signs, self.apart = _followers(signs), _followers(apart)
        # words beside signs are cut otherwise in the counted pairs
        gaps = [*apart, *(row for row in pairs if "han" not in (script(row[0]), script(row[1])))]
        ended: dict[str, float] = defaultdict(float)
        for at, (yes, _) in self.event.items():
            if len(at) == 2 and at[1][0] not in ("\n", " "):
                ended[at[0]] += yes
        self.ended = dict(ended)
        marked = sum(ended.values())
        likely = [
            (last, mark, n, *self.likelihood((last, mark, False, gap, nxt)))
            for mark, gap, of in ((GAP, "space", gaps), (SIGN, "none", signs))
            for last, nxt, n in of
        ]
        for _ in range(rounds):
            event: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for last, mark, n, a, b in likely:
                p = self.p_event(last, mark, False)
                yes = n * p * a / (p * a + (1 - p) * b)
                event[last, mark][0] += yes
                event[last, mark][1] += n - yes
            self.event.update(event)
            lacking = sum(yes for yes, _ in event.values())
            self.unmarked = (lacking + _UNMARKED * _MARKS) / (lacking + marked + _MARKS)

    def p_event(self, last: str, mark: str, one: bool) -> float:
        """Probability of a boundary after a token and mark."""
        if mark in (GAP, SIGN):
            # a word is not believed to lack its mark more often than it has it: labels and titles,
            # that never stand before one, are followed by what begins sentences, too
            y, n = self.event.get((last, mark), (0.0, 0.0))
            ended = self.ended.get(last, 0.0)
            p = (min(y, ended) + self.unmarked * ended + _ANCHOR * GUESS[mark]) / (y + n + self.unmarked * ended + _ANCHOR)
            return min(max(p, 1e-6), 1 - 1e-6)
        p, kind = GUESS[mark], shape(last)
        known = self.abbreviated.get(last, 0.0) if mark[0] == "." else 0.0
        if known > 0.01:
            y, n = 0.05 * _SEED * known, 0.95 * _SEED * known
        elif is_initial(last) and mark == ".":
            y, n = 0.1 * _SEED, 0.9 * _SEED
        elif kind == "0" and mark == ".":
            y, n = 0.4 * _SEED, 0.6 * _SEED
        else:
            y, n = 0.0, 0.0
        p = (y + _ANCHOR * p) / (y + n + _ANCHOR)
        if (last, mark) not in self.event:  # its rows were too small and went to its shape
            last = kind
        if mark in ("\nL", "\nW"):  # wrapped text breaks anywhere: the word before tells nothing
            return p
        weight = 2 * _ANCHOR if kind == last else _ANCHOR
        y, n = self.event.get((last, mark), (0.0, 0.0))
        p = (y + weight * p) / (y + n + weight)
        y, n = self.event.get((last, mark, one), (0.0, 0.0))
        p = (y + _ANCHOR * p) / (y + n + _ANCHOR)
        return min(max(p, 1e-4), 1 - 1e-4)

    def p_start(self, last: str, nxt: str) -> float:
        """Probability that a sentence starts with a token, after one of the same script."""
        p = _mixed(self.start, ("",), nxt, self._by_kind(self.start_shape, nxt))
        return p if other_script(last, nxt) else _mixed(self.start, (script(last),), nxt, p)

    def _by_kind(self, kinds: dict, nxt: str) -> float:
        """Probability of a token's kind, times that of the token among its kind."""
        kind = shape(nxt)
        of_kind = (kinds.get(kind, 0.0) + 0.1) / (kinds.get("", 0.0) + 1)
        return of_kind * (self.token.get(nxt, 0.0) + 0.1) / (self.kind.get(kind, 0.0) + 1)

    def p_cont(self, last: str, mark: str, nxt: str) -> float:
        """Probability that a token follows where no boundary stands.

        What follows the mark and script anywhere, as far as sites without boundary tell,
        and what follows words of that kind and script where no mark stands, both count
        half; the bigrams of the token itself come before them as far as there are any. A line break
        is followed by what follows anywhere, and so is a word by one of another script.
        """
        p = _mixed(self.cont, (), nxt, self._by_kind(self.cont_shape, nxt))
        if other_script(last, nxt):
            return p
        of = script(last)
        p = _mixed(self.cont, (mark[0], of), nxt, p)
        total = self.pairs.get((of, ""), 0.0)
        if not total:
            return p
        if mark == " ":  # where no mark stands only words without one tell
            p = (self.pairs.get((of, "", nxt), 0.0) + 0.5) / (total + 1_000)
        beside = _mixed(self.pairs, (shape(last), "kind"), nxt, _mixed(self.pairs, (of, ""), nxt, p))
        p = (p + beside) / 2
        own = self.pairs.get((last,), 0.0)
        # half at most: a token may be a word of one language and an abbreviation of another
        weight = own / (own + _OWN) / 2
        return weight * self.pairs.get((last, nxt), 0.0) / own + (1 - weight) * p if own else p

    def p_within(self, last: str, mark: str, nxt: str) -> float:
        """Probability that a token follows where neither a mark nor a boundary stands.

        Words tell of words, signs of signs. Behind a word of another script stands what
        stands anywhere in its own; a number is followed by words of all scripts.
        """
        pairs = self.signs if mark == SIGN or script(nxt) == "han" else self.pairs
        other = other_script(last, nxt)
        of = script(nxt if other else last)
        total = pairs.get((of, ""), 0.0)
        if not total:
            return _mixed(self.cont, (), nxt, self._by_kind(self.cont_shape, nxt))
        p = (pairs.get((of, "", nxt), 0.0) + 0.5) / (total + 1_000)
        if mark == GAP and "han" in (script(last), script(nxt)):
            pairs = self.apart
        elif other and shape(last) != "0":
            return p
        else:
            p = (p + _mixed(pairs, (shape(last), "kind"), nxt, p)) / 2
        own = pairs.get((last,), 0.0)
        weight = own / (own + _OWN) / 2
        return weight * pairs.get((last, nxt), 0.0) / own + (1 - weight) * p if own else p

    def p_gap(self, boundary: bool, gap: str) -> float:
        return (self.gaps.get((boundary, gap), 0.0) + 0.5) / (self.gaps.get((boundary,), 0.0) + 2.0)

    def likelihood(self, key: tuple) -> tuple[float, float]:
        """Of what is seen behind the mark, with and without boundary."""
        last, mark, one, gap, nxt = key
        if nxt == END:
            return 1.0, 1e-9
        pairs = self.signs if mark == SIGN else self.pairs
        if nxt not in self.token and (last, nxt) not in pairs and not (mark == GAP and (last, nxt) in self.apart):  # likewise
            nxt = shape(nxt)
        if mark == "thai" and other_script(last, nxt):
            return 1.0, 1.0
        if mark in (GAP, SIGN):
            a, b = self.p_start(last, nxt), self.p_within(last, mark, nxt)
            # a quote begins as a sentence does, wherever it stands
            return (a, (a + b) / 2) if gap == "quote" else (a, b)
        if mark[0] == "\n":  # a wrapped line goes on with a small letter as a rule
            small = is_small(shape(nxt)) or nxt[:1].islower()
            return (0.01, 0.75) if small else (0.99, 0.25)
        return (
            self.p_gap(True, gap) * self.p_start(last, nxt),
            self.p_gap(False, gap) * self.p_cont(last, mark, nxt),
        )

    def posterior(self, key: tuple) -> float:
        p = self.p_event(*key[:3])
        a, b = self.likelihood(key)
        return p * a / (p * a + (1 - p) * b)

    def _terms(self, key: tuple) -> tuple[tuple[float, float], tuple[float, float]]:
        """Boundary probabilities after none and after a boundary; likelihoods of both."""
        known = known_key(key, self.before, self.behind)
        last, mark, one, _, _ = known
        p1 = self.p_event(last, mark, one)
        p0 = self.p_event(last, mark, False) if one else p1
        if len(self._recent) > 100_000:
            self._recent.clear()
        got = self._recent[key] = (p0, p1), self.likelihood(known)
        return got

    def decode(self, keys: list[tuple], settled: list[int]) -> list[float]:
        """Posterior probability of a boundary at each site, by forward-backward.

        ``settled`` is -1 where the model decides, else 0 or 1.

        The event at a site depends on the event before it where one token stands
        between: after a boundary that token is a whole sentence.
        """
        n = len(keys)
        if not n:
            return []
        step, seen = [], []
        recent = self._recent
        for key, p in zip(keys, settled):
            if p >= 0:
                step.append((p, p))
                seen.append((1.0, 1.0))
            else:
                at, like = recent.get(key) or self._terms(key)
                step.append(at)
                seen.append(like)
        forward = []
        before = (0.0, 1.0)  # (no boundary, boundary): a text begins as after one
        for (p0, p1), (yes, no) in zip(step, seen):
            b = (before[0] * p0 + before[1] * p1) * yes
            a = (before[0] * (1 - p0) + before[1] * (1 - p1)) * no
            t = a + b
            before = (a / t, b / t) if t > 0 else (0.5, 0.5)
            forward.append(before)
        out = [0.0] * n
        back = (1.0, 1.0)
        for i in range(n - 1, -1, -1):
            a, b = forward[i][0] * back[0], forward[i][1] * back[1]
            out[i] = b / (a + b) if a + b > 0 else 0.5
            (p0, p1), (yes, no) = step[i], seen[i]
            back = (
                (1 - p0) * no * back[0] + p0 * yes * back[1],
                (1 - p1) * no * back[0] + p1 * yes * back[1],
            )
            t = back[0] + back[1]
            back = (back[0] / t, back[1] / t) if t > 0 else (0.5, 0.5)
        return out


def estimate(
    rows: list[tuple[tuple, float]], before: set[str], behind: set[str],
    pairs: list[tuple[str, str, float]] | None = None, signs: list[tuple[str, str, float]] | None = None,
    apart: list[tuple[str, str, float]] | None = None, rounds: int = ROUNDS,
) -> HiddenEventModel:
    """The model of counted sites (key, n) with known tokens, by expectation-maximisation.

    ``pairs`` are counted bigrams (word, word behind, n), likewise with known tokens, and
    ``signs`` those around places beside signs of Han and kana, ``apart`` around gaps there.
    """
    model = HiddenEventModel(before, behind)
    model.learn_pairs(pairs or [], rows)
    posterior = [first_guess(key, model.abbreviated.get(key[0], 0.0) if key[1][0] == "." else 0.0) for key, _ in rows]
    model.count(rows, posterior)
    for _ in range(rounds):
        posterior = [model.posterior(key) for key, _ in rows]
        model.count(rows, posterior)
    model.learn_gaps(pairs or [], signs or [], apart or [], rounds)
    return model
