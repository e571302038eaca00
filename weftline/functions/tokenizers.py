"""Public tokenizers as Arrow passes: counts, ids with specials, truncation and padding.

The driver reads a tokenizer file once and broadcasts its bytes (at most MOST_BYTES); each
worker builds the tokenizer once from them. Nothing is looked up on a worker's own disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Folder of the public tokenizer files, and the file used by default; both are parameters.
FOLDER = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"
MOST_BYTES = 64 << 20

# Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BUILT: dict[tuple[str, str], Callable[[list[str]], Iterable[list[int]]]] = {}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's kind (by its file's extension), bytes, and the splitting pattern that rank files need."""

    kind: str
    data: bytes
    pattern: str = PATTERN

    def encoder(self) -> Callable[[list[str]], Iterable[list[int]]]:
        """A function from texts to ids without specials, built once per process. Strings of special tokens are ordinary text."""
        key = (hashlib.sha256(self.data).hexdigest(), self.pattern)
        if key not in _BUILT:
            _BUILT[key] = self._build()
        return _BUILT[key]

    def _build(self) -> Callable[[list[str]], Iterable[list[int]]]:
        if self.kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.data.splitlines())}
            encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            # One by one: the library's batch call hands each text to a thread and takes 1.5 times the CPU seconds on texts of this size.
            return lambda texts: map(encoding.encode_ordinary, texts)
        if self.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: model.encode(texts, num_threads=1)
        if self.kind == "json":
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.data.decode())
            tokenizer.encode_special_tokens = True
            return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        raise ValueError(f"no tokenizer of kind {self.kind!r}; known are tiktoken, model and json")


def read_tokenizer(spark: SparkSession, name: str = DEFAULT, folder: str = FOLDER, pattern: str = PATTERN) -> TokenizerFile:
    """A tokenizer file of a local or Hadoop folder; a larger one than MOST_BYTES is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if "://" in folder else f"file://{os.path.abspath(folder)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).getLen() > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    stream = files.open(path)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    return TokenizerFile(name.rsplit(".", 1)[-1], data, pattern)


def _pass(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], columns_of: Callable, tokenizer: TokenizerFile) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    target, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(tokenizer)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoder()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                found = columns_of(encode([t or "" for t in texts]), np.array([t is None for t in texts], bool))
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip([*[batch.column(i) for i in range(len(keep))], *found], target)], schema=target)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(go, schema)


def _lists(rows: list, null: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(null))


def token_counts(df: DataFrame, keep: list[str], tokenizer: TokenizerFile, text: str = "text", specials: int = 0, length: int | None = None) -> DataFrame:
    """keep columns and n_tokens of each text, specials added, at most length; a null text has null tokens."""

    def of(ids: Iterable, null: np.ndarray) -> list[pa.Array]:
        n = np.fromiter(map(len, ids), np.int64, len(null)) + specials
        return [pa.array(n if length is None else np.minimum(n, length), mask=null)]

    return _pass(df, keep, text, [T.StructField("n_tokens", T.LongType())], of, tokenizer)


def token_ids(df: DataFrame, keep: list[str], tokenizer: TokenizerFile, text: str = "text", bos: int | None = None, eos: int | None = None, length: int | None = None, pad: int | None = None, padded: bool = False) -> DataFrame:
    """keep columns, input_ids and attention_mask of each text: bos + ids + eos, the ids cut so that all fit in length, padded to it if asked for.

    Padding without a pad token (or a length) is an error. A null text has null ids.
    """
    if padded and (pad is None or length is None):
        raise ValueError("the tokenizer has no pad token" if pad is None else "padding needs a length")
    front, back = ([] if x is None else [x] for x in (bos, eos))

    def of(ids: Iterable, null: np.ndarray) -> list[pa.Array]:
        room = None if length is None else max(0, length - len(front) - len(back))
        rows = [[*front, *r[:room], *back] for r in ids]
        masks = [[1] * len(r) for r in rows]
        if padded:
            rows, masks = [r + [pad] * (length - len(r)) for r in rows], [m + [0] * (length - len(m)) for m in masks]
        return [_lists(rows, null), _lists(masks, null)]

    return _pass(df, keep, text, [T.StructField("input_ids", T.ArrayType(T.LongType())), T.StructField("attention_mask", T.ArrayType(T.IntegerType()))], of, tokenizer)


def renamed_specials(data: str, names: dict[str, str], probes: list[str] = ()) -> str:
    """A JSON tokenizer with special tokens renamed: in the vocabulary, as unknown token and among the added ones.

    Verified: every new name has the old one's id, the vocabulary keeps its size and other
    ids, and the probe texts have the ids they had. A name that is missing, or taken, is an error.
    """
    from tokenizers import Tokenizer

    model = json.loads(data)
    vocabulary = model["model"]["vocab"]
    added = {t["content"]: t for t in model.get("added_tokens", [])}
    for old, new in names.items():
        if old not in vocabulary and old not in added:
            raise ValueError(f"no token {old!r}")
        if new in vocabulary or new in added:
            raise ValueError(f"{new!r} is taken")
        if old in vocabulary:
            vocabulary[new] = vocabulary.pop(old)
        if old in added:
            added[old]["content"] = new
        if model["model"].get("unk_token") == old:
            model["model"]["unk_token"] = new
    out = json.dumps(model, ensure_ascii=False)
    before, after = Tokenizer.from_str(data), Tokenizer.from_str(out)
    ids = {names.get(t, t): i for t, i in before.get_vocab().items()}
    if after.get_vocab() != ids or before.get_vocab_size() != after.get_vocab_size():
        raise ValueError("ids changed with the names")
    for text in probes:
        if before.encode(text).ids != after.encode(text).ids:
            raise ValueError(f"the ids of {text!r} changed")
    return out
