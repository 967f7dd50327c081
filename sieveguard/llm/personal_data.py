"""Personal data in whole texts: fixed patterns, and a semi-Markov random field over segments.

Four fixed patterns give the base spans (``base_spans``). The random field adds what they cannot
see. Its candidates are whole segments of a bounded number of groups around digits and at-signs,
each with features of the segment as a whole: how its digits are grouped and joined, check digit,
octets, cue words before it. A dynamic program over a stretch of text weighs all ways to lay
candidates side by side, so that boundaries and kinds are chosen together; what lies between
segments scores 0, whatever its length, so stretches far apart are independent. A label remembers
the segment before it. Training maximises the likelihood of labelled lines (``labelled_spans``,
LINES of them) with the sums over all segmentations.

Base spans are certain: no added span overlaps one. Null texts are empty and hold nothing.
Repeated rows are treated alike. Long texts are read whole; time grows with their length. Offsets
count code points, ends are exclusive. Columns named like an added one are refused. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import clear_names, sized_batches, table
from sieveguard.llm.labelled_spans import CUES, OTHER_CUES, labelled_lines, luhn_ok
from sieveguard.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
LINES, SEED = 1_500, 11   # labelled lines the model is trained on
STEPS, RATE, PENALTY = 100, 0.2, 0.5
MAX_GROUPS = 8            # groups of digits in a segment, or labels of a host name
MAX_GAP = 3               # characters between two groups
MARGIN = 1.0              # log-odds a segmentation must gain for each span it adds

Span = tuple[str, int, int]

# The base patterns. A look-behind keeps a search from starting inside digits that
# were tried from their first one, which changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
               for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            number = "".join(DIGITS.findall(m.group()))
            if 16 <= len(number) <= 19 and luhn_ok(number):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", *m.span()))
    return out


# Stretches of text in which a number may lie, and marks around which an address may lie.
NUMBERS = re.compile(r"[0-9][0-9 ()\[\].,/_ ‐-–-]{5,}")
AT_MARK = re.compile(r" ?@ ?| ?[(\[{] ?[aA][tT] ?[)\]}] ?| (?:at|AT) ")
DOT_MARK = re.compile(r"\.|[(\[{]\.[)\]}]| ?[(\[{] ?[dD][oO][tT] ?[)\]}] ?| (?:dot|DOT) ")
LABEL = re.compile(r"[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*")
NAME_END = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?\Z")
NAME_PART = re.compile(r"[A-Za-z0-9]+")
WORD_BEFORE = re.compile(r"[^\W_]+")
DOTLIKE = re.compile(r" ?(?:[(\[]\.[)\]]|\.) ?\Z")

NAMES = (
    "bias", "own cue", "other kind's cue", "other cue", "sign before", "joined before",
    "joined after", "digits next door", "no separator", "one separator", "mixed separators",
    "spaces", "hyphens", "dots", "slashes", "commas", "brackets", "defanged dots", "spaced dots",
    "digits<=7", "digits 8-9", "digits 10", "digits 11", "digits 12", "digits 13-14", "digits 15",
    "digits 16", "digits>=17", "plus", "area in brackets", "starts 0", "starts 00",
    "check digit", "no check digit", "check digit after a cue", "3-3-4", "4-4-4-4", "4-6-5", "thousands", "year", "date",
    "octets", "no octets", "leading 3-6", "at sign", "at in brackets", "at as a word", "plain dot",
    "dot in brackets", "dot as a word", "letters last", "one label", "cue and few groups",
    "single group", "many groups", "3-3-4 after an area", "ten digits after a cue")
INDEX = {n: i for i, n in enumerate(NAMES)}
CUE_KIND = {w: k for k, words in CUES.items() for w in words}


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    features: tuple[int, ...]


def _cues(text: str, start: int, kind: str) -> list[str]:
    words = [w.lower() for w in WORD_BEFORE.findall(text, max(0, start - 24), start)][-2:]
    out = []
    for w in words:
        if w in CUE_KIND:
            out.append("own cue" if CUE_KIND[w] == kind else "other kind's cue")
        elif w in OTHER_CUES:
            out.append("other cue")
    return out


def _alnum(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _number_names(text: str, start: int, end: int, kind: str, groups: list[str],
                  seps: list[str]) -> list[str]:
    number = "".join(groups)
    sizes, n = [len(g) for g in groups], len(number)
    names = ["bias", *_cues(text, start, kind)]
    cue = "own cue" in names
    before = text[start - 1] if start else " "
    if before in "#$€£=<>*@%~^|&":
        names.append("sign before")
    if start > 1 and before in ".,/-:" and text[start - 2].isdigit():
        names.append("joined before")
    if end + 1 < len(text) and text[end] in ".,/-:" and text[end + 1].isdigit():
        names.append("joined after")
    near = text[max(0, start - 3):start] + text[end:end + 3]
    if any(c.isdigit() for c in near):
        names.append("digits next door")
    kinds = {s.strip() or s for s in seps}
    names.append("no separator" if not seps else
                 "one separator" if len(kinds) == 1 else "mixed separators")
    joined = "".join(seps)
    names += [n_ for c, n_ in ((" ", "spaces"), ("-", "hyphens"), (".", "dots"), ("/", "slashes"),
                               (",", "commas"), ("(", "brackets")) if c in joined]
    if seps and all("[" in s or "(" in s for s in seps):
        names.append("defanged dots")
    if seps and all(s == " . " for s in seps):
        names.append("spaced dots")
    names.append("digits<=7" if n <= 7 else "digits 8-9" if n <= 9 else f"digits {n}" if n <= 12
                 else "digits 13-14" if n <= 14 else f"digits {n}" if n <= 16 else "digits>=17")
    head = text[start:start + 1]
    if head == "+":
        names.append("plus")
    if "(" in text[start:start + 2] and ")" in joined:
        names.append("area in brackets")
    if number.startswith("00"):
        names.append("starts 00")
    elif number.startswith("0"):
        names.append("starts 0")
    names.append("check digit" if luhn_ok(number) else "no check digit")
    if cue and luhn_ok(number):
        names.append("check digit after a cue")
    if sizes[-3:] == [3, 3, 4] and len(sizes) <= 4:
        names.append("3-3-4" if len(sizes) == 3 else "3-3-4 after an area")
    if sizes == [4, 4, 4, 4]:
        names.append("4-4-4-4")
    if sizes == [4, 6, 5]:
        names.append("4-6-5")
    if len(sizes) > 1 and sizes[0] <= 3 and all(s == 3 for s in sizes[1:]):
        names.append("thousands")
    if any(len(g) == 4 and g[:2] in ("19", "20") for g in groups):
        names.append("year")
    if len(sizes) == 3 and sorted(sizes) in ([1, 1, 4], [1, 2, 4], [2, 2, 4], [2, 2, 2]):
        names.append("date")
    if len(groups) == 4:
        names.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups)
                     else "no octets")
    if number[0] in "3456":
        names.append("leading 3-6")
    names.append("single group" if len(sizes) == 1 else
                 "many groups" if len(sizes) > 5 else "cue and few groups" if cue else "bias")
    if cue and n == 10:
        names.append("ten digits after a cue")
    return names


def _candidate(kind: str, start: int, end: int, names: list[str]) -> Candidate:
    return Candidate(KINDS.index(kind), start, end, tuple(sorted({INDEX[n] for n in names})))


def number_candidates(text: str, low: int, high: int) -> Iterator[Candidate]:
    """Segments of whole groups of digits within a stretch."""
    groups = [(low + m.start(), low + m.end()) for m in DIGITS.finditer(text[low:high])]
    groups = [g for g in groups if g[1] - g[0] <= 19]
    for i, (first, _) in enumerate(groups):
        if _alnum(text, first - 1):
            continue
        starts = [first]
        if first and text[first - 1] in "+(":
            starts.append(first - 1)
            if first > 1 and text[first - 2] in "+(" and text[first - 1] == "(":
                starts.append(first - 2)
        shown, seps, total = [], [], 0
        for j in range(i, min(len(groups), i + MAX_GROUPS)):
            if j > i:
                gap = text[groups[j - 1][1]:groups[j][0]]
                if len(gap) > MAX_GAP or "\n" in gap:
                    break
                seps.append(gap)
            shown.append(text[groups[j][0]:groups[j][1]])
            total += len(shown[-1])
            end = groups[j][1]
            if total > 19:
                break
            if _alnum(text, end):
                continue
            kinds = [k for k, ok in (
                ("ip", len(shown) == 4 and total <= 12 and all(DOTLIKE.match(s) for s in seps)),
                ("card", 13 <= total <= 19), ("phone", 7 <= total <= 15)) if ok]
            for kind in kinds:
                for start in starts if kind == "phone" else starts[:1]:
                    yield _candidate(kind, start, end, _number_names(
                        text, start, end, kind, shown, seps))


def address_candidates(text: str, mark: re.Match) -> Iterator[Candidate]:
    """Segments around one at-mark: any start in the name before it, any label after it."""
    name = NAME_END.search(text, max(0, mark.start() - 64), mark.start())
    if not name:
        return
    first = [name.start() + m.start() for m in NAME_PART.finditer(name.group())]
    starts = [s for s in first if not _alnum(text, s - 1)][:MAX_GROUPS]
    label = LABEL.match(text, mark.end())
    shown = mark.group().strip()
    at = ("at sign" if shown == "@" else
          "at as a word" if shown.lower() == "at" else "at in brackets")
    dots: list[str] = []
    while label and len(dots) < MAX_GROUPS:
        end = label.end()
        dot = DOT_MARK.match(text, end)
        follows = LABEL.match(text, dot.end()) if dot else None
        if not _alnum(text, end):
            for start in starts:
                names = ["bias", at, *_cues(text, start, "email"),
                         "one label" if not dots else "cue and few groups"]
                if start > name.start():
                    names.append("joined before")
                if follows:
                    names.append("joined after")
                if label.group().isalpha() and 2 <= len(label.group()) <= 6:
                    names.append("letters last")
                if mark.group() != shown:
                    names.append("spaces")
                for d in dots:
                    names.append("plain dot" if d == "." else
                                 "dot as a word" if d.strip().isalpha() else "dot in brackets")
                yield _candidate("email", start, end, names)
        if not follows:
            return
        dots.append(dot.group())
        label = follows


def candidates(text: str) -> list[Candidate]:
    """All candidate segments of a text, each once, by start."""
    found: dict[tuple[int, int, int], Candidate] = {}
    for m in NUMBERS.finditer(text):
        for c in number_candidates(text, *m.span()):
            found[c.kind, c.start, c.end] = c
    marks = []
    if "@" in text:
        marks += [m for m in re.finditer(r" ?@ ?", text)]
    lower = text if "at" in text else text.lower() if "AT" in text or "At" in text else ""
    if lower and ("dot" in text or "DOT" in text or "at)" in lower or "at]" in lower
                  or "at}" in lower or "at " in lower and "[.]" in text):
        marks += [m for m in AT_MARK.finditer(text) if "@" not in m.group()]
    for m in marks:
        for c in address_candidates(text, m):
            found[c.kind, c.start, c.end] = c
    return sorted(found.values(), key=lambda c: (c.start, c.end, c.kind))


@dataclass
class Field:
    """Weights of the features by kind, and of a kind after the kind before it (0: none)."""

    weights: np.ndarray
    follows: np.ndarray

    def score(self, c: Candidate) -> float:
        return float(self.weights[c.kind, list(c.features)].sum())


def stretches(found: Sequence[Candidate], reach: int = 40) -> Iterator[list[Candidate]]:
    """Runs of candidates with at most ``reach`` characters between one and the next."""
    run: list[Candidate] = []
    end = 0
    for c in found:
        if run and c.start > end + reach:
            yield run
            run = []
        run.append(c)
        end = max(end, c.end) if len(run) > 1 else c.end
    if run:
        yield run


def best_segments(field: Field, run: list[Candidate], margin: float = MARGIN) -> list[Candidate]:
    """The segmentation with the highest score: each state is the kind of the last segment."""
    places = sorted({c.start for c in run} | {c.end for c in run})
    index = {p: i for i, p in enumerate(places)}
    ending: dict[int, list[Candidate]] = {}
    for c in run:
        ending.setdefault(index[c.end], []).append(c)
    states = len(KINDS) + 1
    table_: list[list[tuple[float, tuple | None]]] = [[(0.0, None)] + [
        (float("-inf"), None)] * (states - 1)]
    for p in range(1, len(places)):
        now = list(table_[p - 1])
        for c in ending.get(p, ()):
            own = field.score(c) - margin
            for s, (before, path) in enumerate(table_[index[c.start]]):
                total = before + own + field.follows[s, c.kind]
                if total > now[c.kind + 1][0]:
                    now[c.kind + 1] = (total, (c, path))
        table_.append(now)
    _, path = max(table_[-1], key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def train(lines: int = LINES, seed: int = SEED) -> Field:
    """Fit a field to labelled lines: gradient steps on the likelihood of their segmentations."""
    return _train(lines, seed)


@lru_cache(maxsize=4)
def _train(lines: int, seed: int) -> Field:
    run_of, a, b, kind, gold, prior, rows = [], [], [], [], [], [], []
    runs = deepest = 0
    for text, spans in labelled_lines(lines, seed):
        truth = set(spans)
        for run in stretches(candidates(text)):
            places = {p: i for i, p in enumerate(sorted(
                {c.start for c in run} | {c.end for c in run}))}
            last = 0
            for c in run:
                right = (KINDS[c.kind], c.start, c.end) in truth
                run_of.append(runs)
                a.append(places[c.start])
                b.append(places[c.end])
                kind.append(c.kind)
                gold.append(right)
                prior.append(last)
                rows.append(c.features)
                if right:
                    last = c.kind + 1
            runs, deepest = runs + 1, max(deepest, len(places))
    run_of, a, b, kind, prior = (np.array(v) for v in (run_of, a, b, kind, prior))
    gold = np.array(gold)
    x = np.zeros((len(rows), len(NAMES)))
    for i, features in enumerate(rows):
        x[i, list(features)] = 1.0
    at_end = [np.flatnonzero(b == p) for p in range(deepest)]
    at_start = [np.flatnonzero(a == p) for p in range(deepest)]
    states = len(KINDS) + 1
    theta = np.zeros(len(KINDS) * len(NAMES) + states * len(KINDS))
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights = theta[:len(KINDS) * len(NAMES)].reshape(len(KINDS), -1)
        follows = theta[len(KINDS) * len(NAMES):].reshape(states, -1)
        score = (x * weights[kind]).sum(axis=1)
        moves = score[:, None] + follows[:, kind].T          # by state before
        ahead = np.full((deepest, runs, states), -np.inf)
        ahead[0, :, 0] = 0.0
        for p in range(1, deepest):
            ahead[p] = ahead[p - 1]
            s = at_end[p]
            if len(s):
                np.logaddexp.at(ahead[p], (run_of[s], kind[s] + 1), np.logaddexp.reduce(
                    ahead[a[s], run_of[s]] + moves[s], axis=1))
        back = np.zeros((deepest, runs, states))
        for p in range(deepest - 2, -1, -1):
            back[p] = back[p + 1]
            s = at_start[p]
            if len(s):
                np.logaddexp.at(back[p], run_of[s], moves[s] + back[
                    b[s], run_of[s], kind[s] + 1][:, None])
        norm = np.logaddexp.reduce(ahead[-1], axis=1)
        share = np.exp(ahead[a, run_of] + moves + (back[b, run_of, kind + 1] - norm[run_of])[:, None])
        rest = gold - share.sum(axis=1)
        slope = np.zeros((len(KINDS), len(NAMES)))
        turn = np.zeros((states, len(KINDS)))
        for k in range(len(KINDS)):
            own = kind == k
            slope[k] = rest[own] @ x[own]
            turn[:, k] = np.bincount(prior[own & gold], minlength=states) - share[own].sum(axis=0)
        gradient = np.concatenate([slope.ravel(), turn.ravel()]) - PENALTY * theta
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta = theta + RATE * (moment / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Field(theta[:len(KINDS) * len(NAMES)].reshape(len(KINDS), -1).copy(),
                 theta[len(KINDS) * len(NAMES):].reshape(states, -1).copy())


def all_spans(text: str | None, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind and start: base spans, and those the field adds."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, True) for s in base]
    found = candidates(text)
    if found:
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else None

        def free(c: Candidate) -> bool:
            at = int(np.searchsorted(starts, c.end)) if taken else 0
            return not at or reach[at - 1] <= c.start

        for run in stretches([c for c in found if free(c)]):
            out += [(KINDS[c.kind], c.start, c.end, False) for c in best_segments(field, run)]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,base:boolean,text:string>>"


def find_spans(docs: DataFrame, field: Field | None = None, carry: Sequence[str] | None = None
               ) -> DataFrame:
    """``docs`` (the columns ``carry``, default all) with ``spans``: kind, start, end, whether a
    base pattern gave it, and the text it covers."""
    clear_names(docs, ["spans"])
    carry = list(docs.columns if carry is None else carry)
    schema = docs.select(*carry).withColumn("spans", F.lit(None).cast(SPAN_TYPE)).schema
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("base", pa.bool_()), ("text", pa.string())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "_text", 4 << 20):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [[(k, s, e, base, t[s:e]) for k, s, e, base in all_spans(t, shared.value)]
                     for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(spans, pa.list_(span))], names=[*carry, "spans"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(compute, schema)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    counts = {f"n_{k}": F.size(F.filter(base, partial(_is_kind, k))).cast("long") for k in KINDS}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
