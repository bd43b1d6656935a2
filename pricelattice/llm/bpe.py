"""Exact byte-pair encoding by backtracking over longest token matches, and decoding from an offset table."""

from __future__ import annotations

import functools
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import giving_back, ship, slices, table, with_fields

#: Most pieces of text, and pairs of tokens, whose answers a worker keeps while a task runs.
PIECES, PAIRS = 400_000, 500_000
#: Characters for which this module splits and lower-cases itself; tests hold each against the library.
PLAIN = regex.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class BacktrackingBpe:
    """Encodes as the merges of a vocabulary file do, in time linear in the text.

    A symbol is a byte, or a byte that ends its word. Longest matches come from an Aho-Corasick automaton over the
    tokens' symbols. A token may follow another if merging would leave just these two: the pair's history is undone
    step by step and must never have offered an earlier merge across the border. If no token fits, the last one is
    taken back and shortened; positions that lead nowhere are marked, so none is tried twice.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_symbol = [chr(b) for b in range(256)]
        self.end_symbol = [chr(0x100 + b) for b in range(256)]
        self.symbols: dict[str, str] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for b in range(256):
            self.symbols[letters[b]] = self.byte_symbol[b]
            self.symbols[letters[b] + self.suffix] = self.end_symbol[b]
        for rank, (a, b) in enumerate(model["merges"]):
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = token
            if a + b not in self.symbols:
                self.symbols[a + b] = self.symbols[a] + self.symbols[b]
                self.rank[token], self.parts[token] = rank, (vocab[a], vocab[b])
        self.length: dict[int, int] = {}
        self.matcher = ahocorasick.Automaton()
        by_symbols = {}
        for token, own in self.symbols.items():
            if token in vocab:
                self.length[vocab[token]] = len(own)
                by_symbols[own] = vocab[token]
        for own, token in by_symbols.items():
            self.matcher.add_word(own, (token, len(own)))
        self.matcher.make_automaton()
        #: The longest token that is a proper prefix of a token.
        self.shorter: dict[int, int | None] = {}
        for own, token in by_symbols.items():
            self.shorter[token] = next((by_symbols[own[:k]] for k in range(len(own) - 1, 0, -1) if own[:k] in by_symbols), None)
        self.size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        #: By left * size + right.
        self.pairs: dict[int, bool] = {}
        #: The ids of chunks and of words, which are chunks of their own.
        self.pieces: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        contents = [b""] * self.size
        for content, k in {**vocab, **self.special}.items():
            contents[k] = content.encode() + b" "
        self.bytes = np.frombuffer(b"".join(contents), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols together ends in just these two tokens."""
        known = self.pairs.get(left * self.size + right)
        if known is not None:
            return known
        a, b, rank = left, right, self.rank
        limit = 1 << 60
        out = True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and rank[joined] < limit:
                out = False
                break
            # Undo the later of the two last merges: what stood at the border before it.
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left * self.size + right] = out
        return out

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def forget(self) -> None:
        """Leaves the tables, and no answers: a worker that is used again, for whatever, does not hold them."""
        self.pairs, self.pieces = {}, {}

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        own = data[:-1].decode("latin-1") + self.end_symbol[data[-1]]
        n = len(own)
        # Matches come by their end; of those that begin at one place the last is the longest.
        longest = {end - k: (token, k) for end, (token, k) in self.matcher.iter(own)}
        token, size = longest[-1]
        if size == n:
            return [token]
        out: list[int] = []
        dead: set[int] = set()
        pairs, length, shorter, n_tokens = self.pairs, self.length, self.shorter, self.size
        at, last = 0, -1
        while True:
            while token is not None:
                end = at + size
                if end not in dead:
                    ok = last < 0 or pairs.get(last * n_tokens + token)
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                token = shorter[token]
                if token is not None:
                    size = length[token]
            if token is None:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
                if token is not None:
                    size = length[token]
                continue
            out.append(token)
            if end == n:
                return out
            at, last = end, token
            token, size = longest[at - 1]

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids, as 32-bit integers, of plain characters without white space."""
        low = chunk.lower()
        if low.isalpha():
            ids = self.pieces.get(low) if low != chunk else None
            return self.keep(chunk, array("i", self.encode_word(low)).tobytes() if ids is None else ids)
        out = []
        for w in WORDS.findall(low):
            ids = self.pieces.get(w)
            out.append(self.keep(w, array("i", self.encode_word(w)).tobytes()) if ids is None else ids)
        return self.keep(chunk, b"".join(out))

    def encode_rest(self, text: str) -> bytes:
        """The same of any text without special tokens, normalised and split by the library."""
        back = {ch: b for b, ch in enumerate(byte_letters())}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        ids = [k for w, _ in split for k in self.encode_word(bytes(back[c] for c in w).decode())]
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        known, chunk = self.pieces.get, self.encode_chunk
        out = []
        for part in self.special_split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            elif PLAIN.fullmatch(part):
                out += [known(c) or chunk(c) for c in part.split()]
            else:
                out.append(self.encode_rest(part))
        return b"".join(out)

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The texts of rows ids[off[k]:off[k+1]]: token contents gathered by offset, a blank between two."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(start - (ends - size), size)
        flat = self.bytes[where].tobytes()
        cut = np.concatenate([[0], ends])[off]
        return [flat[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def _encode(path: str, text: str, keep: list[str]):
    @giving_back
    def run(batches):
        bpe = load(path)
        try:
            for batch in batches:
                for part in slices(batch, text):
                    rows = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                    off = np.cumsum([0, *map(len, rows)]) // 4
                    ids = np.frombuffer(b"".join(rows), np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                    texts = pa.array(bpe.decode_all(ids, off), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists, texts], [*keep, "ids", "decoded"])
        finally:
            bpe.forget()

    return run


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids (array of int) and decoded (the ids' text) of every whole text.

    Null and empty texts have no ids and an empty decoded text. Rows are independent: ties and repeated rows need
    nothing, other columns are not read. A worker holds the ids of about a megabyte of text, or of one longer text.
    path is a vocabulary file that every executor can open.
    """
    ship(docs.sparkSession)
    keep = list(keep)
    source = docs.select(*keep, text)
    schema = with_fields(docs.select(*keep).schema, "ids array<int>, decoded string")
    return source.mapInArrow(_encode(path, text, keep), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
