"""BPE encoding and decoding by forced boundaries.

A token never spans two bytes that are adjacent in no token of the vocabulary,
so between such bytes a text can be cut for certain: the fragments are encoded
independently and their ids concatenated. White space and the ends of words are
such cuts too, as tokens hold no white space and words carry an end mark. Most
fragments come again and again, so their ids are kept, in tables of bounded size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import lean, slices

#: Entries of the tables of words and fragments (about 25 MB each), and characters of one; a full table is emptied.
KEPT, LONGEST = 150_000, 100
#: Rows of a batch that a task returns at once.
ROWS = 512

#: Texts made of these alone need no library: they are in composed form already, and Python's lower case and
#: white space are the tokenizer's. Ranges of code points; the control characters 28 to 31 and 133 are not among them.
PLAIN = [(9, 13), (32, 126), (160, 303), (306, 382), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for a, b in PLAIN for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind)


class Bpe:
    """A tokenizer of the ``tokenizers`` library's JSON format: byte-level BPE with word ends, no decoder."""

    def __init__(self, source: bytes | str):
        import tokenizers

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or not model["end_of_word_suffix"]:
            raise ValueError("expected BPE with an end-of-word suffix and no decoder")
        if model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("expected plain merges")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.library = tokenizers.Tokenizer.from_str(source.decode() if isinstance(source, bytes) else source)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [(a, b) for a, b in pairs]
        # the library's merges, for fragments within a word and for those at its end
        self.inner = tokenizers.models.BPE(self.vocab, merges)
        self.last = self.library.model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mapping = dict(enumerate(byte_chars()))
        # byte pairs that some token holds; between any other pair is a boundary
        self.inside = {t[i : i + 2] for t in (x.removesuffix(self.end) for x in self.vocab) for i in range(len(t) - 1)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = split.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        letters, numbers = _class("L"), _class("N")
        inner = plain.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
        self.split = re.compile(inner.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        self.odd = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in PLAIN) + "]")
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = _Table(self._word)
        self.fragments = _Table(self._fragment)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as the library gives them without adding special tokens."""
        parts: list[bytes] = []
        for i, segment in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                parts.append(np.int32(self.special[segment]).tobytes())
            elif segment:
                parts += self._segment(segment)
        return np.frombuffer(b"".join(parts), np.int32)

    def _segment(self, text: str) -> list[bytes]:
        if self.odd.search(text):
            # other scripts: the library's own normal form and split; cuts and merges are ours
            normal = self.library.normalizer.normalize_str(text)
            return [self._mapped(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return list(map(self.words.__getitem__, text.lower().split()))

    def _word(self, word: str) -> bytes:
        return b"".join(self._mapped(piece.encode().decode("latin-1").translate(self.mapping)) for piece in self.split.findall(word))

    def _mapped(self, piece: str) -> bytes:
        """A piece, its bytes written as characters: cut at forced boundaries, the last fragment with the end mark."""
        cuts = [0, *[i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.inside], len(piece)]
        last = len(cuts) - 2
        return b"".join(self.fragments[piece[a:b] + (self.end if i == last else "")] for i, (a, b) in enumerate(zip(cuts, cuts[1:])))

    def _fragment(self, fragment: str) -> bytes:
        if fragment.endswith(self.end):
            found = self.last.tokenize(fragment.removesuffix(self.end))
        else:
            found = self.inner.tokenize(fragment)
        return np.array([t.id for t in found], np.int32).tobytes()


def token_list(source: bytes) -> list[str]:
    """The tokens by id, special ones too."""
    spec = json.loads(source)
    named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max(named.values()))
    for token, i in named.items():
        tokens[i] = token
    return tokens


def decode_ids(tokens: list[str], ids: list[int]) -> str:
    """What the library's decode gives without a decoder, special tokens kept: tokens with a space between."""
    return " ".join(map(tokens.__getitem__, ids))


class _Table(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        value = self.make(key)
        if len(key) < LONGEST:  # long ones come once, and would take the memory
            self[key] = value
        return value


_loaded: dict = {}


def _once(make, source: bytes):
    """What ``make`` makes of a tokenizer, kept for a worker's next task."""
    if _loaded.get("source") != source:
        _loaded.clear()
        _loaded["source"] = source
    if make not in _loaded:
        _loaded[make] = make(source)
    return _loaded[make]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row, and the column decoded, the text of these ids, if that is asked for.

    The tokenizer's file is read by the driver and sent to the workers (a file of fixed size). A null or empty text
    has no ids. Rows are encoded one by one, so repeated rows and null ids come out as they came in. Other columns
    are not read. Texts are decoded in the pass that encodes them, so a task needs one worker.
    """
    with open(tokenizer_path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _once(Bpe, source.value)
        tokens = _once(token_list, source.value) if decoded else []
        for batch in slices(batches, ROWS):
            found = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            cols, names = [batch.column(0), ids], ["id", "ids"]
            if decoded:
                cols, names = [*cols, pa.array([decode_ids(tokens, x.tolist()) for x in found], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded: the text of the ids. Null ids give a null text; a column of that name is replaced."""
    with open(tokenizer_path, "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _once(token_list, source.value)
        for batch in slices(batches, ROWS):
            ids = batch.column(at)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [decode_ids(tokens, flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(lean(run), schema)
