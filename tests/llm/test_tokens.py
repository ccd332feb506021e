import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from labelfold.llm import tokens
from tests.conftest import SF

PATH = tokens.public_path("byte_bpe_50k.json")


@pytest.mark.parametrize("plain", [True, False])
def test_ids_equal_those_of_tokenizers(plain):
    rng = random.Random(8)
    signs = [chr(c) for r in ((0, 0x250), (0x370, 0x600), (0x1680, 0x1690), (0x1800, 0x1820), (0x2000, 0x2070), (0x3000, 0x3040), (0x1F600, 0x1F610))
             for c in range(*r)] + ["a", " ", "\n", "'s", "'ll", "'", "1", "<|endoftext|>"] * 60
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]
    texts += ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(4000)]
    texts += [" " * 5000 + "x", "x" * 5000, "　" * 2001, " <|endoftext|> <|endoftext|>", "é" * 1999 + " ", ""]
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = plain
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.ByteIds(PATH, plain)(texts)] == want
    held = tokens.token_bytes(PATH)
    assert all(b"".join(held[i] for i in ids) == t.encode() for ids, t in zip(want, texts))


def test_text_runs_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"], "n": [1, 2, 3, 4, 5]}).slice(1)
    runs = list(tokens.text_runs(batch, limit=20))
    assert [r.column("n").to_pylist() for r in runs] == [[2], [3], [4, 5]]
