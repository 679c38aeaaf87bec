"""Byte-level BPE with a whole-token shortcut, used inside Spark tasks.

The shortcut: a vocabulary string that the tokenizer, given it alone, encodes
as exactly one token and that is exactly one pre-token can be counted (or
emitted) without running any merges, because pre-tokens are encoded
independently of each other.  `prove_whole_tokens` establishes that set once,
before the job, by running every vocabulary string through the library.  Only
pre-tokens outside the set are merged, by the library itself, and their results
are memoised per worker.

Pieces with characters whose class could differ between Unicode versions are cut
into pre-tokens by the library's own pre-tokeniser; each pre-token then takes the
same way.  Only texts that hold a special-token string are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from tokenizers import Tokenizer

from streamweave.llm.worker import KEPT

#: The letters of the characters that texts on the quick path consist of.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: Anything else is left to the library's pre-tokeniser: its class may depend on
#: the Unicode version, or it is a digit-like character outside 0-9.
UNUSUAL = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ſ]").search
#: The byte-level pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|
#: ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+) over those characters.
PRETOKENS = re.compile(rf" [{LETTERS}]+|[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
#: A single space between two characters that no version of Unicode calls white space.
SURE = re.compile(r"(?<=[^\s\u180e\ufeff]) (?=[^\s\u180e\ufeff])")
#: Memoised chunks and pre-tokens per generation (two are kept in each memo), and the longest of them.
CHUNKS, PIECES, LONGEST = 180_000, 30_000, 64


def shortcut_applies(config: str) -> bool:
    """True if the file is the plain byte-level BPE that the argument is about."""
    spec = json.loads(config)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return bool(
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
        and all(not (t.get("normalized") or t.get("lstrip") or t.get("rstrip")) for t in spec.get("added_tokens", []))
    )


def prove_whole_tokens(config: str) -> dict[str, int]:
    """Vocabulary strings that alone are one pre-token and encode as one token."""
    if not shortcut_applies(config):
        return {}
    tok = Tokenizer.from_str(config)
    special = {t["content"] for t in json.loads(config).get("added_tokens", [])}
    texts = sorted({tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size(with_added_tokens=False))})
    cut = tok.pre_tokenizer.pre_tokenize_str
    texts = [t for t in texts if t and "\ufffd" not in t and t not in special and (len(cut(t)) == 1 if UNUSUAL(t) else PRETOKENS(t) == [t])]
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    return {t: x[0] for t, x in zip(texts, ids, strict=True) if len(x) == 1}


def byte_alphabet() -> list[str]:
    """The byte-level model's letter for each byte: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class _Memo(dict):
    """Computes what it lacks; a full generation becomes the old one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Unsure(Exception):
    """White space at a chunk's edge: the cut there isn't proven."""


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the library's.

    Texts are cut at their single spaces.  Between two characters that aren't
    white space such a space always begins a pre-token, and what follows doesn't
    depend on what came before, so the chunks (a word with its punctuation) are
    memoised too.
    """

    def __init__(self, config: str, whole: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tok = Tokenizer.from_str(config)
        self.special = [t["content"] for t in json.loads(config).get("added_tokens", [])]
        self.quick = shortcut_applies(config)
        self.letters = str.maketrans(dict(enumerate(byte_alphabet())))
        self.whole = {t: array("I", [i]).tobytes() for t, i in whole.items()}
        self.by_letters = {self._lettered(t): x for t, x in self.whole.items()}
        self.merges = self.tok.model.tokenize
        self.cut = self.tok.pre_tokenizer.pre_tokenize_str if self.quick else None
        self.piece = _Memo(self._merge, PIECES).__getitem__
        self.lettered = _Memo(self._merge_letters, PIECES).__getitem__
        self.chunk = _Memo(self._chunk, CHUNKS).__getitem__

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _lettered(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _merge_letters(self, letters: str) -> bytes:
        """The shortcut, or else the library's merges, for one pre-token in the model's letters."""
        known = self.by_letters.get(letters)
        return known if known is not None else array("I", [t.id for t in self.merges(letters)]).tobytes()

    def _merge(self, pretoken: str) -> bytes:
        known = self.whole.get(pretoken)
        return known if known is not None else self._merge_letters(self._lettered(pretoken))

    def _segment(self, text: str) -> bytes:
        """Ids of a part of a text that begins and ends where pre-tokens do."""
        if UNUSUAL(text):
            return b"".join([self.lettered(p) for p, _ in self.cut(text)])
        return b"".join(map(self.piece, PRETOKENS(text)))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and not UNUSUAL(chunk):
            return self._merge(" " + chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace() or chunk[0] in "\u180e\ufeff" or chunk[-1] in "\u180e\ufeff":
            raise _Unsure
        return self._segment(" " + chunk)

    def ids(self, text: str | None) -> bytes:
        """Ids of one text; null and empty texts have none."""
        if not text:
            return b""
        if not self.quick or any(s in text for s in self.special):
            return self._library(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace() or first[-1] in "\u180e\ufeff":
                raise _Unsure
            return b"".join((self._segment(first), *map(self.chunk, rest)))
        except _Unsure:
            head, *more = SURE.split(text)
            return b"".join((self._segment(head), *(self._segment(" " + x) for x in more)))


def encoder(config: str, whole: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its memo lives across batches."""
    key = "encoder", hash(config)
    if key not in KEPT:
        KEPT[key] = Encoder(config, json.loads(whole))
    return KEPT[key]
