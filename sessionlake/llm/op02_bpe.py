"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one vocabulary token can be the last token of the prefix's encoding. An automaton
over the vocabulary gives the tokens that are suffixes of each prefix; a token is that last one if it is compatible
with the last token of the prefix before it, i.e. if no merge would have crossed their boundary. The ids of the word
follow from back-pointers, without applying merges to the text.

Defined results: a null text is an empty text, which has no ids; a text of spaces has none either; texts are never cut;
the literal special tokens in a text are encoded as special ids, as the public library does by default; repeated rows
give a row each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the end-of-word mark as a single character; a private-use character that byte-level text can't hold.
END = ""
#: White space as the vocabulary's normaliser sees it (Unicode White_Space).
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
NEVER = 1 << 62
#: Entries of each cache of words, and of known neighbours: a worker keeps them while it runs other operators.
CACHED_WORDS, KNOWN_FITS = 100_000, 200_000


def byte_alphabet() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class PrefixEncoder:
    """Encodes words of one vocabulary file (tokenizers JSON, BPE with an end-of-word suffix)."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, known_fits: int = KNOWN_FITS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        seal = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.vocab = {seal(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(seal(a), seal(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.made = {}
        for (a, b), rank in self.merges.items():
            self.made.setdefault(a + b, (a, b, rank))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.automaton = ahocorasick.Automaton()
        for t in self.vocab:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[str, str], bool] = {}
        #: Chunks seen lately, and before that; when the first is full it becomes the second. The same for the words in them.
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.word_cache: dict[str, tuple[int, ...]] = {}
        self.cached_words, self.known_fits = cached_words, known_fits

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts at the token's last (side 1) or first (side 0) edge, each with the rank of the merge that absorbs it."""
        found = self.spines[side].get(token)
        if found is None:
            found, part, absorbed = [], token, NEVER
            while True:
                found.append((part, absorbed))
                if part not in self.made:
                    break
                a, b, absorbed = self.made[part]
                part = b if side else a
            self.spines[side][token] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses the boundary before the parts beside it are absorbed; at equal ranks the left merge goes first."""
        known = self.fits.get((left, right))
        if known is None:
            known = True
            for x, x_gone in self.spine(left, 1):
                for y, y_gone in self.spine(right, 0):
                    rank = self.merges.get((x, y))
                    if rank is not None and rank < x_gone and rank <= y_gone:
                        known = False
            if len(self.fits) >= self.known_fits:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def word(self, piece: str) -> list[int]:
        """Ids of one word: last tokens of all its prefixes, then the back-pointers from its end."""
        text = piece.encode("utf-8").decode("latin-1").translate(self.alphabet) + END
        last: list[str | None] = [""] + [None] * len(text)
        fits, compatible = self.fits, self.compatible
        for at, token in self.automaton.iter(text):
            if last[at + 1] is None:
                before = last[at + 1 - len(token)]
                if before is not None:
                    fit = True if before == "" else fits.get((before, token))
                    if compatible(before, token) if fit is None else fit:
                        last[at + 1] = token
        ids, end = [], len(text)
        while end:
            token = last[end]
            ids.append(self.vocab[token])
            end -= len(token)
        return ids[::-1]

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        """Ids and tokens of a piece of normalised text without white space, as joined text."""
        found = self.older.get(chunk)
        if found is None:
            ids: list[int] = []
            for piece in self.pieces.findall(chunk):
                own = self.word_cache.get(piece)
                if own is None:
                    own = tuple(self.word(piece))
                    if len(self.word_cache) >= self.cached_words // 2:
                        self.word_cache.clear()
                    if len(piece) <= 100:
                        self.word_cache[piece] = own
                ids += own
            found = (" ".join(map(str, ids)), " ".join([self.text_of[i] for i in ids]), len(ids))
        if len(self.cache) >= self.cached_words:
            self.cache, self.older = {}, self.cache
        if len(chunk) <= 100:
            self.cache[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space: words never cross it, so it is otherwise dropped."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if SEPARATORS.search(text):  # str.split takes these for white space too
            return [c for c in SPACES.sub(" ", text).lower().split(" ") if c]
        return text.lower().split()

    def encode_joined(self, text: str) -> tuple[str, str, int]:
        """(ids joined by one space, decoded text, number of ids) of a whole text."""
        parts: list[tuple[str, str, int]] = []
        whole = self.special_split is None or not any(s in text for s in self.special)
        for run in [text] if whole else self.special_split.split(text):
            if run in self.special:
                parts.append((str(self.special[run]), run, 1))
                continue
            get, chunk = self.cache.get, self.chunk
            for c in self.chunks(run):
                found = get(c)
                if found is None:
                    found = chunk(c)
                    get = self.cache.get
                parts.append(found)
        if any(not p[2] for p in parts):
            parts = [p for p in parts if p[2]]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space: the vocabulary file names no decoder."""
        return " ".join([self.text_of[i] for i in ids])


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker process and file: its tables and its cache of words are kept between batches."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with_ids adds ids (array<int>) and decoded.

    A map over partitions without a shuffle. Each worker holds one vocabulary and a bounded cache of words.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, decoded, n = enc.encode_joined(text.as_py() or "")
                row = (doc_id.as_py(), n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + ([int(i) for i in ids.split()], decoded) if with_ids else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32()), pa.string()] if with_ids else [])
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
