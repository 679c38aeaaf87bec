"""Personal data: base patterns, and a character BiLSTM-CRF that adds to them (operator 8).

The base patterns find e-mail and IP addresses, card and phone numbers.  The
tagger is trained, on the driver, from a bounded sample of windows around base
spans and around other digits, with written-out variants of the same kinds mixed
in.  It reads windows that overlap by half.  Each position takes its scores from
the window it is most central in, so a run of overlapping windows is one sequence
of scores, which is decoded at once; a document's spans are then reconciled by
weighted interval scheduling.

A span must hold a digit, an @ or a bracketed "at" or "dot", so windows without
one, and without a part of the word it stands in, can't have a span: they are
skipped, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.bilstm_crf import Tagger
from streamweave.llm.common import arrow_udf, drop_clashing, fresh, hash_share, table

KINDS = ("email", "ip", "card", "phone")
#: Window and stride in code points.
WINDOW, STRIDE = 96, 48
#: Longest run decoded at once, by half overlapping: spans up to half of it are seen whole
#: (an e-mail address has at most 320 characters); and the reach of the word around an anchor.
DECODED, REACH = 1024, 320
#: Windows whose scores are held at a time.
HELD = 2048
#: Training bounds: documents drawn, characters of each, windows, and their width.
TRAINING_DOCS, LONGEST, TRAINING_WINDOWS, TRAINED = 600, 20_000, 2_400, 64
#: Least posterior probability, on average over a span, for it to be added.
SURE = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind.

    Matches that fail their test are dropped and not tried again.  E-mail is
    matched from each @ outwards, which gives the leftmost match in linear time.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def codes_of(text: str) -> np.ndarray:
    """0 padding, 1 another character, 2 white space, 3 a letter beyond ASCII, 4.. printable ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where((points > 32) & (points < 127), points - 29, np.where(points <= 32, 2, np.where(points > 191, 3, 1)))
    return out.astype(np.int64)


SYMBOLS = 127 - 29


def windows_of(text: str) -> list[int]:
    """Starts of the windows around each anchor and the word that it stands in."""
    n = len(text)
    last = max(0, -(-(n - WINDOW) // STRIDE))
    starts: set[int] = set()
    upto = -1
    for m in ANCHOR.finditer(text):
        at = m.start()
        if at < upto:
            continue
        low = text.rfind(" ", max(0, at - REACH), at) + 1 or max(0, at - REACH)
        high = text.find(" ", at, at + REACH)
        high = min(n, at + REACH) if high < 0 else high
        upto = min(high, (at // STRIDE + 1) * STRIDE)  # the rest of this stride adds nothing
        first, end = max(0, low // STRIDE - 1), min(last, high // STRIDE)
        starts.update(range(min(first, last), end + 1))
    return [k * STRIDE for k in sorted(starts)]


def reconcile(proposals: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Non-overlapping proposals (weight, kind, start, end) of the largest total weight."""
    best: dict[tuple[int, int, int], float] = {}
    for w, k, a, b in proposals:
        best[k, a, b] = max(w, best.get((k, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, take = [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        with_it = best[s] + total[before]
        take.append((with_it > total[-1], before))
        total.append(max(with_it, total[-1]))
    out, i = [], len(spans)
    while i:
        used, before = take[i - 1]
        if used:
            out.append(spans[i - 1])
            i = before
        else:
            i -= 1
    return out[::-1]


def plausible(kind: int, text: str) -> bool:
    """Shape that a proposed span must have to be personal data of its kind at all."""
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return len(text) >= 6 and (text.count("@") == 1 or bool(re.search(r"[(\[{]\s?at\s?[)\]}]", text, re.I))) and bool(re.search(r"\.|dot", text))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn(re.sub("[^0-9]", "", text)) and text[0].isdigit() and text[-1].isdigit()
    return 9 <= digits <= 15 and bool(re.fullmatch(r"[\x20()./0-9+-]+", text))


def _scores(tagger: Tagger, texts: list[str], runs: list[tuple[int, list[int]]], batch: int = 512) -> list[np.ndarray]:
    """Scores (characters, tags) of each run, every position from the window it is most central in."""
    where = [(i, s) for i, starts in runs for s in starts]
    parts = []
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        codes = np.zeros((WINDOW, len(part)), np.int64)
        for j, (i, s) in enumerate(part):
            c = codes_of(texts[i][s : s + WINDOW])
            codes[: len(c), j] = c
        parts += list(tagger.emissions(codes)[0].transpose(1, 0, 2))
    edge, out, at = (WINDOW - STRIDE) // 2, [], 0
    for i, starts in runs:
        mine = [p[edge if k else 0 : WINDOW - edge if k + 1 < len(starts) else WINDOW] for k, p in enumerate(parts[at : at + len(starts)])]
        at += len(starts)
        out.append(np.concatenate(mine)[: len(texts[i]) - starts[0]])
    return out


def _runs(texts: list[str]):
    """(text, starts of overlapping windows), in lists of about HELD windows."""
    group, held = [], 0
    for i, text in enumerate(texts):
        starts = windows_of(text)
        cuts = [0, *(k for k in range(1, len(starts)) if starts[k] - starts[k - 1] > STRIDE), len(starts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                group.append((i, starts[a:b]))
                held += b - a
                if held >= HELD:
                    yield group
                    group, held = [], 0
    if group:
        yield group


def model_spans(tagger: Tagger, texts: list[str], batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans of each text that the tagger is sure of, reconciled over its runs."""
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for runs in _runs(texts):
        scores = _scores(tagger, texts, runs)
        # Pieces of runs: whole, or overlapping by half.
        pieces = []
        for r, e in enumerate(scores):
            for a in range(0, max(1, len(e) - DECODED // 2), DECODED // 2):
                pieces.append((r, a, min(len(e), a + DECODED)))
        pieces.sort(key=lambda p: p[2] - p[1])
        for at in range(0, len(pieces), batch):
            part = pieces[at : at + batch]
            e = np.full((part[-1][2] - part[-1][1], len(part), tagger.tags), -1e4, np.float32)
            e[:, :, 0] = 0.0  # behind a piece's end nothing stands
            for j, (r, a, b) in enumerate(part):
                e[: b - a, j] = scores[r][a:b]
            tags, sure = tagger.best_path(e), tagger.marginals(e)
            for j, (r, first, end) in enumerate(part):
                i, starts = runs[r]
                for a in np.nonzero(tags[: end - first, j] % 2 == 1)[0].tolist():
                    b = a + 1
                    while b < end - first and tags[b, j] == tags[a, j] + 1:
                        b += 1
                    if a == 0 and first or b == end - first and end < len(scores[r]):  # whole in the neighbouring piece
                        continue
                    weight = float(sure[np.arange(a, b), j, tags[a:b, j]].mean())
                    kind, s = int(tags[a, j] - 1) // 2, starts[0] + first
                    if weight >= SURE and plausible(kind, texts[i][s + a : s + b]):
                        found[i].append((weight * (b - a), kind, s + a, s + b))
    return [reconcile(x) for x in found]


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, spans added by the tagger) of each text; added ones touch no base span."""
    base = [base_spans(t) for t in texts]
    more = model_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for b, m in zip(base, more, strict=True):
        taken = sorted((s, e) for _, s, e in b)
        free = [x for x in m if not any(s < x[2] and x[1] < e for s, e in taken)] if taken else m
        out.append((b, free))
    return out


def variants(rng: np.random.Generator, n: int) -> list[tuple[str, int]]:
    """Written-out forms of the four kinds that the base patterns don't cover."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(letters[i] for i in rng.integers(0, 26, rng.integers(a, b)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda xs: xs[rng.integers(len(xs))]

    def mail():
        at, dot = pick([(" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "."), ("[at]", "[dot]"), (" {at} ", " {dot} ")])
        name = word(2, 10) + pick(["", "", ".", "_", "-"]) + pick([word(2, 12), word(3, 9) + digits(2)])
        return f"{name}{at}{dot.join(word(3, 14) for _ in range(rng.integers(1, 4)))}{dot}{pick(['com', 'org', 'net', 'de', 'fr', 'edu', 'io'])}"

    def address():
        gap = pick(["[.]", " . ", "(.)", "[dot]", " dot "])
        return gap.join(str(x) for x in rng.integers(0, 256, 4))

    def card():
        front = pick("3456") + digits(14)
        whole = next(front + str(d) for d in range(10) if luhn(front + str(d)))
        return pick([".", "/", "_", " - "]).join(whole[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(6)}", f"0{digits(3)}/{digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])

    makers = [(mail, 0), (address, 1), (card, 2), (phone, 3), (mail, 0), (phone, 3)]  # the kinds of many forms come twice
    return [(make(), kind) for make, kind in (makers[i % 6] for i in range(n))]


def planted(host: str, text: str, rng: np.random.Generator) -> tuple[str, int]:
    """The host with a form put between two of its words, and where it begins."""
    at = host.find(" ", int(rng.integers(0, max(1, len(host) - 1)))) + 1
    before = host[:at] if at or not host else ""
    return f"{before}{text} {host[at:]}", len(before)


def shapes(text: str) -> list[tuple[int, int, int]]:
    """Spans of the form of each kind: what the tagger learns, as check digits and ranges are
    tested afterwards."""
    cards = [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= sum(map(str.isdigit, m[0])) <= 19]
    return [x for x in base_spans(text) if x[0] != 2 and not any(a < x[2] and x[1] < b for _, a, b in cards)] + cards


def training_windows(texts: list[str], rng: np.random.Generator, width: int = TRAINED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags around shapes, other digits and planted variants."""
    cases: list[tuple[str, list[tuple[int, int, int]], int]] = []
    for t in texts:
        spans = shapes(t)
        centres = [(a + b) // 2 for _, a, b in spans]
        others = [m.start() for m in re.finditer(r"[0-9@]+", t) if not any(a <= m.start() < b for _, a, b in spans)]
        centres += [int(x) for x in rng.choice(others, min(2, len(others)), replace=False)] if others else []
        cases += [(t, spans, c) for c in centres]
    order = rng.permutation(len(cases))[: TRAINING_WINDOWS // 2]
    picked = [cases[i] for i in order]
    plain = [t for t in texts if len(t) > 40 and not ANCHOR.search(t)] or ["plain words stand here and nothing else does "]
    for text, kind in variants(rng, TRAINING_WINDOWS // 2 if cases else 0):
        whole, at = planted(plain[rng.integers(len(plain))], text, rng)
        picked.append((whole, [(kind, at, at + len(text))], at + len(text) // 2))
    codes, tags = np.zeros((len(picked), width), np.int64), np.zeros((len(picked), width), np.int64)
    for row, (t, spans, centre) in enumerate(picked):
        first = max(0, centre - int(rng.integers(width // 6, width - width // 6)))
        c = codes_of(t[first : first + width])
        codes[row, : len(c)] = c
        for kind, a, b in spans:
            a, b = a - first, b - first
            if b > 0 and a < width:
                tags[row, max(0, a) : min(width, b)] = 2 + 2 * kind
                tags[row, max(0, a)] = 1 + 2 * kind
    return codes, tags


def train(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """Fit the tagger on a bounded sample: about TRAINING_DOCS different texts with
    an anchor, cut to LONGEST characters, drawn by the text's hash."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("hash"), F.substring(text_col, 1, LONGEST).alias("t"))
    n = rows.agg(F.approx_count_distinct("hash")).first()[0]
    drawn = rows.where(hash_share("hash", F.lit(8)) * F.lit(n) < TRAINING_DOCS).groupBy("hash").agg(F.min("t").alias("t")).collect()
    texts = [r["t"] for r in sorted(drawn, key=lambda r: (r["hash"], r["t"]))]
    codes, tags = training_windows(texts, np.random.default_rng(5))
    if not len(codes):
        return None
    tagger = Tagger(SYMBOLS, len(KINDS))
    tagger.fit(codes, tags)
    return tagger


SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_pii(df: DataFrame, tagger: Tagger | None, text_col: str = "text", name: str = "pii_spans") -> DataFrame:
    """Add an array of spans (kind, start, end, base) in code points, end exclusive.

    Spans are ordered by kind (as in KINDS), then start.  Null and empty texts
    have none.  Each row is read by itself: repeated rows and ids, or null ids, don't
    matter.  A column of that name is replaced, all others are kept.  An empty table
    gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def spans(batches):
        for texts in batches:
            rows = []
            for base, more in all_spans(shared.value, [t or "" for t in texts.to_pylist()]):
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in both])
            yield pa.array(rows, kind)

    udf = arrow_udf(df.sparkSession, spans, SPAN)
    (text,) = fresh(df, "text")
    kept = drop_clashing(df.withColumn(text, F.col(text_col)), [name])
    return kept.withColumn(name, udf(F.col(text))).drop(text)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones merge."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, spans_col: str = "pii_spans", text_col: str = "text") -> DataFrame:
    """Replace the text by its redacted form; null texts stay null, repeated rows are treated alike, an empty table stays empty."""

    def replaced(batches):
        for rows in batches:
            texts, spans = rows.field(0).to_pylist(), rows.field(1).to_pylist()
            yield pa.array([None if t is None else redact(t, [(s["kind"], s["start"], s["end"]) for s in x or []]) for t, x in zip(texts, spans, strict=True)], pa.string())

    udf = arrow_udf(df.sparkSession, replaced, "string")
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, udf(F.struct(text_col, spans_col))).otherwise(F.col(text_col)))


def redact_found(df: DataFrame, tagger: Tagger | None, text_col: str = "text", name: str = "n_spans") -> DataFrame:
    """What `find_pii` and `redacted` do, in one pass: the text redacted, and the number of its spans.

    Null texts stay null with no spans, empty ones empty; each row is read by itself,
    so repeated rows are redacted alike; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.struct([("text", pa.string()), ("n", pa.int64())])

    def redact_each(batches):
        for texts in batches:
            given = texts.to_pylist()
            rows = []
            for t, (base, more) in zip(given, all_spans(shared.value, [t or "" for t in given]), strict=True):
                spans = [(KINDS[k], a, b) for k, a, b in [*base, *more]]
                rows.append({"text": redact(t, spans) if spans else t, "n": len(spans)})
            yield pa.array(rows, kind)

    udf = arrow_udf(df.sparkSession, redact_each, "struct<text:string,n:long>")
    (found,) = fresh(df, "found")
    out = drop_clashing(df.withColumn(found, udf(F.col(text_col))), [name])
    return out.withColumns({text_col: F.col(found)["text"], name: F.col(found)["n"]}).drop(found)


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    shown = lambda only: F.array_join(F.transform(F.filter("pii_spans", lambda s: s["base"] | F.lit(not only)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(True).cast("binary"), 256).alias("base_sha256"),
        shown(False).alias("spans"),
    )
