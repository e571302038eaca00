"""Public tokenizers against a second library, and what their operators do with odd texts."""

import json
from pathlib import Path

import pytest

from weftline.functions import tokenizers

pytestmark = pytest.mark.skipif(not Path(tokenizers.FOLDER).exists(), reason="no tokenizer files")
TEXTS = ["The old farmer's basket", "האיכר הזקן נשא את הסל", "", None, "x" * 20_000, "<|endoftext|> 🙂\n\t  y", "def f(x):\n    return {x: 1}"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "k int, text string, input_ids string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_ids_of_two_libraries_agree(spark, df, name):
    from tokenizers import Tokenizer

    second = Tokenizer.from_file(f"{tokenizers.FOLDER}/byte_bpe_50k.json")
    second.encode_special_tokens = True
    own = tokenizers.read_tokenizer(spark, name)
    got = {r["k"]: r["input_ids"] for r in tokenizers.token_ids(df, ["k"], own).collect()}
    assert got == {i: None if t is None else second.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    counts = {r["k"]: r["n_tokens"] for r in tokenizers.token_counts(df, ["k"], own, specials=2, length=50).collect()}
    assert counts == {i: None if x is None else min(50, len(x) + 2) for i, x in got.items()}


def test_sentence_pieces(spark, df):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers.FOLDER}/piece_bpe_32k.model")
    got = {r["k"]: r["input_ids"] for r in tokenizers.token_ids(df, ["k"], tokenizers.read_tokenizer(spark, "piece_bpe_32k.model")).collect()}
    assert got == {i: None if t is None else model.encode(t) for i, t in enumerate(TEXTS)}


def test_specials_truncation_and_padding(spark, df):
    own = tokenizers.read_tokenizer(spark)
    bare = {r["k"]: r["input_ids"] for r in tokenizers.token_ids(df, ["k"], own).collect()}
    for r in tokenizers.token_ids(df, ["k"], own, bos=1, eos=2, length=8, pad=0, padded=True).collect():
        if bare[r["k"]] is None:
            assert r["input_ids"] is None and r["attention_mask"] is None
            continue
        real = [1, *bare[r["k"]][:6], 2]
        assert r["input_ids"] == real + [0] * (8 - len(real)) and r["attention_mask"] == [1] * len(real) + [0] * (8 - len(real))
    with pytest.raises(ValueError, match="pad"):
        tokenizers.token_ids(df, ["k"], own, length=8, padded=True)
    with pytest.raises(ValueError):
        tokenizers.TokenizerFile("bin", b"").encoder()
    assert tokenizers.token_ids(df.limit(0), ["k"], own).count() == 0


def test_renamed_specials_keep_their_ids():
    from tokenizers import Tokenizer

    data = Path(f"{tokenizers.FOLDER}/byte_bpe_50k.json").read_text()
    out = tokenizers.renamed_specials(data, {"<|endoftext|>": "[END]"}, ["a text", "עוד"])
    assert Tokenizer.from_str(out).token_to_id("[END]") == Tokenizer.from_str(data).token_to_id("<|endoftext|>") and "<|endoftext|>" not in json.loads(out)["model"]["vocab"]
    for names in ({"absent": "x"}, {"<|endoftext|>": "the"}):
        with pytest.raises(ValueError):
            tokenizers.renamed_specials(data, names)
