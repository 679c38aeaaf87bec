"""Language identification by cross-parsing entropy (operator 5).

A suffix automaton of labelled text per language recognises every substring of
it.  A text is parsed greedily into longest matches; a language that the text is
written in needs few of them.  The number of phrases, times log2 of the training
length, estimates the bits the text costs given that language; the cheapest
language wins.

Automata are sparse: the transitions of all languages lie in one hash table, so
an alphabet may be as large as the samples make it.  In a task many texts are
parsed at once: texts are cut into blocks that are lanes of one numpy state
machine over all languages.  A block's parse goes on from where the block before
it ended, so the blocks don't show in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, code_points, crc_mod, drop_clashing, fresh, hash_share, table

UNDETERMINED = "und"
#: Bounds of the training sample: languages, documents and characters per language,
#: and characters of one document.
LANGUAGES, DOCS_PER_LANGUAGE, CHARS_PER_LANGUAGE, CHARS_PER_DOC = 1_000, 200, 20_000, 20_000
#: Characters of all languages together: the automata take some 600 bytes for each, in the driver and in each worker.
CHARS_IN_ALL = 400_000
#: Characters parsed in one lane, characters of text parsed together, characters
#: after which a parse from another state has mostly met the one from the root,
#: and rounds of lanes until what has not met is parsed character by character.
BLOCK, TOGETHER, MEET, ROUNDS = 512, 2_000_000, 64, 6
SPACE = 1
#: Code points with a code table of their own (all planes with cased letters).
POINTS = 0x30000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal_text(text: str) -> str:
    """Lower case, every run of non-letters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the sequence's suffix automaton; 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move


class CrossParser:
    """Automata of all languages in one table of transitions, and lanes over it."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text} - {" "})
        code = {" ": SPACE} | {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        # Code of every code point: 0 unknown letter, 1 not a letter, else a letter's.
        self.code = np.array([code.get(chr(i).lower()[:1], 0) if chr(i).isalpha() else SPACE for i in range(POINTS)], np.int32)
        keys, targets, roots, base = [], [], [], 0
        self.first = np.zeros((len(self.languages), self.width), np.int64)  # from the root; the root itself where it has none
        for i, name in enumerate(self.languages):
            move = suffix_automaton([code[c] for c in samples[name]])
            roots.append(base)
            self.first[i] = base
            for c, t in move[0].items():
                self.first[i, c] = base + t
            keys += [(base + s) * self.width + c for s, out in enumerate(move) for c in out]
            targets += [base + t for out in move for t in out.values()]
            base += len(move)
        self.bits = [np.log2(max(2, len(samples[name]))) for name in self.languages]
        self.roots = np.array(roots, np.int64)
        self._fill(np.array(keys, np.int64), np.array(targets, np.int64))
        self._plain: dict[int, int] | None = None

    def _fill(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """Open addressing with at most a quarter of the slots in use."""
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.keys, self.targets = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several the last one stays
            placed = self.keys[slot[left]] == keys[left]
            self.targets[slot[left[placed]]] = targets[left[placed]]
            left = left[~placed]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).view(np.int64)

    def _next(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """States after one more character; -1 where the match ends."""
        key = state * self.width + codes
        slot = self._slot(key)
        found = self.keys[slot]
        hit = found == key
        more = ~hit & (found >= 0)
        while more.any():
            at = np.nonzero(more)
            slot[at] = slot[at] + 1 & self.mask
            found = self.keys[slot[at]]
            hit[at] = found == key[at]
            more[at] = ~hit[at] & (found >= 0)
        return np.where(hit, self.targets[slot], -1)

    def codes(self, text: str) -> np.ndarray:
        points = code_points(text)
        far = points >= POINTS
        out = self.code[np.where(far, 0, points)]
        if far.any():
            out[far] = [0 if chr(p).isalpha() else SPACE for p in points[far]]
        space = out == SPACE
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        return out[keep]

    def _run(self, state: np.ndarray, lanes: np.ndarray, sizes: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(states, phrases ended) after characters start..end of lanes sorted by falling size."""
        state, count = state.copy(), np.zeros(state.shape, np.int64)
        active = np.searchsorted(-sizes, -np.arange(start, end), side="left")
        for t, n in zip(range(start, end), active, strict=True):
            if not n:
                break
            now, codes = state[:, :n], lanes[t, :n]
            after = self._next(now, np.broadcast_to(codes, now.shape))
            over = after < 0
            first = self.first[:, codes]
            root = self.roots[:, None]
            count[:, :n] += over * ((now != root).astype(np.int64) + (first == root))
            state[:, :n] = np.where(over, first, after)
        return state, count

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases of the greedy parse of each text."""
        coded = [self.codes(t) for t in texts]
        parts = [-(-len(c) // BLOCK) for c in coded]
        total = np.zeros((len(coded), len(self.languages)), np.int64)
        if not sum(parts):
            return total
        owner = np.repeat(np.arange(len(coded)), parts)
        blocks = [c[i : i + BLOCK] for c in coded for i in range(0, len(c), BLOCK)]
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        lane_of = np.empty(len(order), np.int64)
        lane_of[order] = np.arange(len(order))
        before = np.where(np.r_[True, owner[1:] != owner[:-1]], -1, np.r_[-1, lane_of[:-1]])[order]  # lane of the block before
        lanes = np.zeros((int(sizes.max()), len(blocks)), np.int64)
        for lane, i in enumerate(order):
            lanes[: sizes[i], lane] = blocks[i]
        owner, sizes = owner[order], sizes[order]
        root = np.repeat(self.roots[:, None], len(blocks), axis=1)
        meet = min(MEET, len(lanes))
        came, (middle, early) = root, self._run(root, lanes, sizes, 0, meet)
        end, late = self._run(middle, lanes, sizes, meet, len(lanes))
        # Go on from where the block before really ended.
        for _ in range(ROUNDS):
            comes = np.where(before >= 0, end[:, before], root)
            turned = np.nonzero((comes != came).any(axis=0))[0]
            if not len(turned):
                break
            came = comes
            some, few = self._run(came[:, turned], lanes[:, turned], sizes[turned], 0, meet)
            apart = (some != middle[:, turned]).any(axis=0)
            middle[:, turned], early[:, turned] = some, few
            rest = turned[apart]
            if len(rest):
                end[:, rest], late[:, rest] = self._run(middle[:, rest], lanes[:, rest], sizes[rest], meet, len(lanes))
        last = np.ones(len(blocks), bool)
        last[before[before >= 0]] = False
        count = early + late + (last & (end != root))
        np.add.at(total, owner, count.T)
        comes = np.where(before >= 0, end[:, before], root)
        for i in np.unique(owner[(comes != came).any(axis=0)]):
            total[i] = [self._one(coded[i], k) for k in range(len(self.languages))]
        return total

    def _one(self, codes: np.ndarray, language: int) -> int:
        """Phrases of one text in one language, character by character."""
        if self._plain is None:
            used = self.keys >= 0
            self._plain = dict(zip(self.keys[used].tolist(), self.targets[used].tolist(), strict=True))
        move, width, root, first = self._plain.get, self.width, int(self.roots[language]), self.first[language].tolist()
        at, n = root, 0
        for c in codes.tolist():
            after = move(at * width + c)
            if after is None:
                n += at != root
                at = first[c]
                n += at == root
            else:
                at = after
        return n + (at != root)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        wanted = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        at = 0
        while at < len(wanted):
            group, size = [], 0
            while at < len(wanted) and (not group or size < TOGETHER):
                group.append(wanted[at])
                size += len(texts[wanted[at]])
                at += 1
            cost = self.phrases([texts[i] for i in group]) * np.array(self.bits)
            best = cost.argmin(axis=1)
            odds = np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000.0))
            share = 1.0 / odds.sum(axis=1)
            for i, b, s in zip(group, best, share, strict=True):
                names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def training_samples(docs: DataFrame, text_col: str, lang_col: str, learn) -> dict[str, str]:
    """Normalised text per language, from a bounded sample drawn by the hash of text and language.

    At most about DOCS_PER_LANGUAGE different texts a language (of the LANGUAGES
    most frequent ones) reach the driver, each cut to CHARS_PER_DOC characters;
    CHARS_PER_LANGUAGE characters of them are learned (fewer if all languages together
    would have over CHARS_IN_ALL), so that languages have equal shares.  Repeated rows count once, whatever their ids.
    """
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang_"), F.col(text_col).alias("text_"))
    rows = rows.withColumn("hash_", F.xxhash64("lang_", "text_"))
    counts = rows.groupBy("lang_").agg(F.approx_count_distinct("hash_").alias("n_"), F.count("*").alias("rows_"))
    known = counts.orderBy(F.desc("rows_"), "lang_").limit(LANGUAGES).select("lang_", "n_").collect()
    if not known:
        return {}
    few = spark.createDataFrame(known, "lang_ string, n_ long")  # at most LANGUAGES rows
    some = rows.join(F.broadcast(few), "lang_").where(hash_share("hash_") * F.col("n_") < DOCS_PER_LANGUAGE)
    drawn = some.groupBy("lang_", "hash_").agg(F.min(F.substring("text_", 1, CHARS_PER_DOC)).alias("text_")).collect()
    out: dict[str, list[str]] = {}
    for row in sorted(drawn, key=lambda r: (r["hash_"], r["text_"])):
        out.setdefault(row["lang_"], []).append(normal_text(row["text_"]))
    most = min(CHARS_PER_LANGUAGE, CHARS_IN_ALL // len(out)) if out else 0
    texts = {k: " ".join(x for x in v if x)[:most] for k, v in out.items()}
    return {k: v for k, v in texts.items() if v}


def identify(df: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1, the winner's share of 2**-bits).

    `samples` holds normalised text per language; the automata are built from it
    once and go to the workers as flat arrays.  Null texts and texts without a letter
    are `und` with score 0, as is everything if nothing was learned.  Ties go to
    the first language by name.  Columns of the two names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(CrossParser(dict(sorted(samples.items()))))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def languages(batches):
        parser = shared.value
        for texts in batches:
            names, scores = parser.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    udf = arrow_udf(df.sparkSession, languages, "struct<lang_pred:string,score:double>")
    text, found = fresh(df, "text", "found")
    kept = drop_clashing(df.withColumn(text, F.col(text_col)), ["lang_pred", "score"])
    out = kept.withColumn(found, udf(F.col(text)))
    return out.withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(text, found)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    samples = training_samples(docs, "text", "lang", ~held_out & F.col("doc_id").isNotNull())
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
