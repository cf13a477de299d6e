"""Personal data in texts: base patterns, and spans that a character-level BiLSTM-CRF adds.

The tagger learns from labelled spans: those of the base patterns in a bounded sample of windows, and made ones (written
variants of the four kinds, and secrets such as keys and tokens) set into such windows. Whole texts are covered by
overlapping windows, and all of them are decoded. The windows' tags are reconciled over the whole text: each character
takes the tag of the window in which it lies farthest from an edge, and spans are read off the joined tags. A span is added
if its path leads the one without it by enough, which is calibrated on sample windows that were held back, and if it
overlaps no base span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bilstm_crf import Tagger, char_ids
from .common import pieces, smallest

KINDS = ("email", "ip", "card", "phone")
#: What the tagger knows besides.
MORE = ("secret",)
#: Windows to decode, and windows to learn from.
SIZE, STRIDE, LEARNT = 288, 256, 96

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken whole: what follows a run decides whether it matches, from wherever in the run one begins.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str):
    """Leftmost non-overlapping matches, sought around each `@` only."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind; failing matches are dropped and not tried again."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern, good in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m[0])]
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{(KINDS + MORE)[k]}:{a}:{b}" for a, k, b in spans)


#: What added spans look like, for those who want the patterns to have the last word (`strict`).
_ADDED = (
    (re.compile(r"[^\s@<>()\[\],;:\"]{2,}@[^\s@<>()\[\],;:\"]{2,}"), lambda s: True),
    (re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}"), lambda s: _is_ip(s.replace(" ", ""))),
    (re.compile(r"[0-9](?:[ .-]{0,2}[0-9])+"), _is_card),
    (re.compile(r"(?:\+|00|\(?0)[0-9() ./-]{6,}[0-9]"), lambda s: _is_phone(s) and any(c in "() -/." for c in s)),
    (re.compile(r"[A-Za-z0-9_+/=.-]{12,}"), lambda s: True),
)


def _strict(text: str, a: int, kind: int, b: int) -> bool:
    pattern, good = _ADDED[kind]
    return bool(pattern.fullmatch(text, a, b)) and good(text[a:b])


def windows(n: int) -> np.ndarray:
    """Starts of the windows that cover n characters."""
    return np.arange(max(1, 1 - (SIZE - n) // STRIDE)) * STRIDE if n else np.zeros(0, np.int64)


def spans_of(places: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of tagged places (ascending); an inside tag that continues nothing begins a span."""
    if not len(places):
        return []
    kind = (tags - 1) // 2
    goes_on = (tags[1:] % 2 == 0) & (kind[1:] == kind[:-1]) & (places[1:] == places[:-1] + 1)
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((first[1:], [len(places)])) - 1
    return list(zip(places[first].tolist(), kind[first].tolist(), (places[last] + 1).tolist(), strict=True))


def tagged(texts: list[str], tagger: Tagger, batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text by the reconciled tags of all its windows.

    A text takes six bytes a character here; tags are kept where there are any.
    """
    out: list[list] = [[] for _ in texts]
    starts = [windows(len(t)) for t in texts]
    room = [(int(s[-1]) + SIZE if len(s) else 0) for s in starts]
    base = np.concatenate(([0], np.cumsum(room))).astype(np.int64)
    ids = np.zeros(int(base[-1]), np.uint8)
    for t, at in zip(texts, base.tolist()):
        for k in range(0, len(t), 1 << 20):
            part = char_ids(t[k : k + (1 << 20)])
            ids[at + k : at + k + len(part)] = part
    own = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)
    last = np.concatenate((own[1:] != own[:-1], [True])) if len(own) else np.zeros(0, bool)
    every = np.lib.stride_tricks.sliding_window_view(ids, SIZE) if len(ids) else ids
    edge = (SIZE - STRIDE) // 2
    text_of, place_of, tag_of = [], [], []
    for j in range(0, len(own), batch):
        some = slice(j, j + batch)
        tags = tagger.decode(every[base[own[some]] + start[some]], tagger.least)
        w, k = np.nonzero(tags)
        # of two windows the one whose edge is farther away has the say
        mine = ((k >= edge) | (start[some][w] == 0)) & ((k < SIZE - edge) | last[some][w])
        w, k = w[mine], k[mine]
        text_of.append(own[some][w])
        place_of.append(start[some][w] + k)
        tag_of.append(tags[w, k].astype(np.int64))
    if text_of:
        text, place, tag = (np.concatenate(x) for x in (text_of, place_of, tag_of))
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        for t in np.unique(text):
            out[t] = spans_of(place[cuts[t] : cuts[t + 1]], tag[cuts[t] : cuts[t + 1]])
    return out


def added_spans(texts: list[str], bases: list[list], tagger: Tagger, strict: bool = False, kinds: int = len(KINDS)) -> list[list]:
    """For each text the spans of the first `kinds` kinds that the tagger adds to its base spans."""
    out = []
    for text, base, found in zip(texts, bases, tagged(texts, tagger), strict=True):
        taken, at, more = sorted(base), 0, []
        for a, kind, b in found:
            while at < len(taken) and taken[at][2] <= a:
                at += 1
            free = all(y <= a or b <= x for x, _, y in taken[at : at + 8])
            if free and kind < kinds and (not strict or _strict(text, a, kind, b)):
                more.append((a, kind, b))
        out.append(more)
    return out


def _variants(rng: np.random.Generator) -> tuple[str, int]:
    """A written variant of some kind, and the kind."""
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda lo=3, hi=9: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéöñ"), rng.integers(lo, hi)))
    kind = int(rng.integers(0, 5))
    if kind == 0:
        name = pick(w(), w(1, 4) + "." + w(), w() + "_" + w(), w() + n(2), w().title() + "." + w().title(), w() + "+" + w(), w() + "-" + w(), w() + "." + n(2))
        return name + pick("@", "@", "@", " @ ", "(at)", "[at]") + pick(w(), w() + "-" + w(), "mail." + w(), w() + n(1)) + pick(".", ".", ".", "[.]") + pick("com", "org", "net", "de", "co.uk", "fr", "io"), kind
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick(".", ".", " . ", "[.]", "(.)", ",", " .").join(parts) + pick("", "", ":" + n(4)), kind
    if kind == 2:
        size = pick(13, 14, 15, 16, 16, 16, 16, 19)
        d = n(size - 1)
        d = next(d + str(x) for x in range(10) if luhn(d + str(x)))
        cuts = [4, 10, 15] if size == 15 else [4, 10, 14] if size == 14 else list(range(4, size, 4)) + [size]
        groups = [d[a:b] for a, b in zip([0, *cuts], cuts) if d[a:b]]
        return pick(" ", "-", "", ". ", ".", "  ", "/", " - ").join(groups), kind
    if kind == 3:
        groups = [n(int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 5)))]
        while sum(map(len, groups)) < 7:
            groups.append(n(4))
        head = pick("+" + n(2) + " ", "+" + n(1) + " ", "+" + n(3) + "-", "00" + n(2) + " ", "0", "(0" + n(2) + ") ", "(" + n(3) + ") ", "+" + n(2) + " (0)", n(1) + "-", n(3) + "-", n(3) + ".", "+" + n(2), "+" + n(2) + " (" + n(3) + ") ")
        return head + pick(" ", "-", ".", "/", " ", "-").join(groups), kind
    letters = pick("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-")
    return pick("", "", "", "sk-", "AK", "key_", "ghx_") + "".join(rng.choice(list(letters), int(rng.integers(20, 49)))), kind


def _near_misses(rng: np.random.Generator) -> str:
    """Something with digits, signs or long words that is no personal data."""
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda lo=3, hi=14: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(lo, hi)))
    year, month = str(rng.integers(1700, 2100)), str(rng.integers(1, 29))
    return pick(
        year, f"{year}-0{n(1)}-1{n(1)}", f"{month}.{month}.{year}", f"{month}/{month}/{year}", f"{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(2)}:{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)},{n(3)}", f"{n(1)},{n(3)},{n(3)}", f"${n(2)}.{n(2)}",
        f"{n(2)}%", n(3), n(4), n(5), n(6), f"{n(1)} to {n(2)}", f"{n(3)}-{n(3)}", f"no. {n(2)}", f"@{w()}", f"{w()} @ {w()}", f"{w()}{n(2)}", w(12, 30), f"{w()}_{w()}", f"https://www.{w()}.org/{w()}", f"{w()}.{w()}", f"({n(1)})", f"[{n(2)}]", f"{n(2)}x{n(2)}",
        f"{w()}-{w()}-{w()}", f"{w()}/{w()}", f"#{n(4)}", f"{n(2)} + {n(2)} = {n(3)}", f"{w().upper()}", f"&&& {w()}*** $$$", f"| {w()} | {n(2)} |", f"{n(1)}.{n(1)}.{n(1)}", f"{w()}={n(2)}", f'{w()} = "{w()}"', f"at {w()} dot", "x" * int(rng.integers(5, 60)), "--------", "........", f"isbn {n(1)}",
    )


def labelled_windows(docs: DataFrame, texts: int = 3000, most: int = 1500) -> list[str]:
    """The bounded sample that the tagger learns from: of `texts` different texts (those with the smallest hashes) at most `most` windows with a digit or `@` and as many without."""
    t = F.col("text").cast("string")
    rows = docs.select(t.alias("text")).filter("text IS NOT NULL AND text != ''")
    n = rows.count()
    if n > 4 * texts:
        rows = rows.filter(F.xxhash64("text") < int(-(2**63) + 2 * texts / n * 2.0**64))
    rows = smallest(rows.distinct(), ["text"], texts)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("text") - LEARNT) / LEARNT), F.lit(0)).cast("int"))
    cut = rows.select(F.explode(F.transform(starts, lambda k: F.substring("text", k * LEARNT + 1, F.lit(LEARNT)))).alias("w")).distinct().withColumn("has", F.col("w").rlike("[0-9@]")).withColumn("h", F.xxhash64("w"))
    place = F.row_number().over(Window.partitionBy("has").orderBy("h", "w"))
    return [r["w"] for r in cut.withColumn("place", place).filter(F.col("place") <= most).orderBy("has", "h", "w").select("w").collect()]


def train(sample: list[str], seed: int = 5, variants: int = 3000, misses: int = 1500, epochs: int = 7, hidden: int = 12) -> Tagger:
    """A tagger from the windows' base spans, made spans and near misses set into windows; the same for the same sample.

    A fifth of the windows is held back: the lead of the spans that the tagger finds there outside the base spans, which are
    taken to be wrong, is what a span has to exceed from then on (the highest but for one in a hundred windows).
    """
    rng = np.random.default_rng(seed)
    held, sample = [w[:LEARNT] for w in sample[::5]], [w[:LEARNT] for k, w in enumerate(sample) if k % 5]
    rows = [(w, base_spans(w)) for w in sample]
    plain = [w for w, s in rows if not s and not _TRIGGER.search(w)] or ["the quick word and then another one follows here with some more to say"]
    words = sorted({x for w in plain for x in w.split()})

    def context(text: str, kind: int | None) -> tuple[str, list]:
        base = plain[int(rng.integers(0, len(plain)))]
        before = ["", " ", "(", '"', ": ", "= ", '= "', "<", " - ", "\n", "| "][int(rng.integers(0, 11)) if rng.random() < 0.5 else 1]
        after = ["", " ", ")", '"', ". ", ", ", ">", "; ", "\n", " |", "%%%"][int(rng.integers(0, 11)) if rng.random() < 0.5 else 1]
        head = int(rng.integers(0, max(1, min(len(base), LEARNT - len(text) - 2))))
        w = (base[:head] + before + text + after + base[head:])[:LEARNT]
        a = head + len(before)
        return w, [] if kind is None else [(a, kind, min(a + len(text), len(w)))]

    rows += [context(*_variants(rng)) for _ in range(variants)]
    held += [context(_near_misses(rng), None)[0] for _ in range(misses // 4)]
    rows += [context(_near_misses(rng), None) for _ in range(misses)]
    for _ in range(misses // 4):  # other orders of the corpus's own words
        rows.append((" ".join(words[k] for k in rng.integers(0, len(words), 20))[:LEARNT], []))
    rows = [(w, s or base_spans(w)) for w, s in rows]
    tags = np.zeros((len(rows), LEARNT), np.int64)
    for row, (_, spans) in zip(tags, rows, strict=True):
        for a, kind, b in sorted(spans, key=lambda s: s[0] - s[2]):
            if not row[a:b].any():  # of overlapping spans the longest
                row[a], row[a + 1 : b] = 2 * kind + 1, 2 * kind + 2
    tagger = Tagger(len(KINDS + MORE), hidden=hidden)
    tagger.fit(_batch([w for w, _ in rows]), tags, epochs=epochs)
    ids = _batch(held)
    e = tagger.emissions(ids)
    leads = []
    for w, a, b, lead in tagger.margins(e, np.where(ids == 0, 0, tagger.viterbi(e))):
        if not any(a < y and x < b for x, _, y in base_spans(held[w])):
            leads.append(lead)
    tagger.least = max([2.0, *sorted(leads)[: max(0, len(leads) - len(held) // 100)]])
    return tagger


def _batch(texts: list[str]) -> np.ndarray:
    ids = np.zeros((len(texts), LEARNT), np.int64)
    for row, t in zip(ids, texts, strict=True):
        row[: len(t)] = char_ids(t)
    return ids


def _found(texts: list[str], tagger: Tagger, strict: bool = False, kinds: int = len(KINDS)):
    """(base spans, all spans) of each text."""
    bases = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    more = added_spans(texts, bases, tagger, strict, kinds)
    return [(b, sorted([*b, *m])) for b, m in zip(bases, more, strict=True)]


def find_pii(docs: DataFrame, tagger: Tagger | None = None, strict: bool = False, secrets: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each document; the counts are the base's.

    Offsets are code points. Null texts are empty; null and repeated doc_ids and rows are kept. An empty table gives an
    empty table. Other columns are not read. Spans that overlap are told apart by start, then kind. A text is held by one
    task: about 15 bytes a character. The tagger is trained on a bounded sample of the documents where none is given.
    strict: added spans have to look like the written forms of their kind, too. secrets: spans of that kind are given as well.
    """
    kinds = len(KINDS + MORE) if secrets else len(KINDS)
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(labelled_windows(docs)))

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                found = _found(b.column(1).to_pylist(), shared.value, strict, kinds)
                counts = np.zeros((4, len(found)), np.int64)
                for row, (base, _) in enumerate(found):
                    for _, kind, _ in base:
                        counts[kind, row] += 1
                sha = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts), pa.array(sha), pa.array([written(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{(KINDS + MORE)[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None, strict: bool = False) -> DataFrame:
    """docs with the spans of all kinds masked in column text, secrets included; a null text stays null, all other columns stay as they are. The rest as in find_pii."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(labelled_windows(docs)))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for b in pieces(batch, place):
                texts = b.column(place).to_pylist()
                found = _found([t or "" for t in texts], shared.value, strict, len(KINDS + MORE))
                new = [None if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)]
                yield b.set_column(place, b.schema.field(place), pa.array(new, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
