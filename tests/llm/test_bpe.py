import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from pagelantern.llm import bpe
from pagelantern.llm.common import table

PATH = bpe.tokenizer_path()
OURS, THEIRS = bpe.Tokenizer(PATH), Library.from_file(PATH)


def check(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode([text])[0].tolist() == want
    assert OURS.decode(want) == THEIRS.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_mixed_pieces():
    rng = random.Random(2)
    pieces = ["the", "ing", " ", "  ", "\n", "'s", "'re", "<|endoftext|>", "<|endof", "12", "é", "中", "　", "😀", "aaaa", "_", "\x1c", "\x85", "=="]
    for _ in range(500):
        check("".join(rng.choices(pieces, k=12)))


def test_every_token_by_itself():
    for b in OURS.bytes_of[::7]:
        try:
            check(b.decode())
        except UnicodeDecodeError:
            pass


def test_cache_limits_do_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 500)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    for text in ("one two three four five six", "seven eight one two", "one one one"):
        check(text)


def test_columns_nulls_and_long_texts(frame):
    rows = [(1, None, "keep", None), (2, "", None, "x"), (2, "", None, "x"), (None, "hello world", "a", "b"), (4, "word " * 50000, "", "")]
    docs = frame(rows, "doc_id long, text string, ids string, other string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == 5 and {r.decoded for r in got} == {"", "hello world", "word " * 50000}
    assert all(len(r.ids) == len(THEIRS.encode(r.text or "").ids) for r in got)
    assert bpe.encode(frame([], docs.schema), PATH).count() == 0


def test_query_on_table(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in table(spark, sf_dir, "documents").collect():
        ids = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe(spark, sf_dir).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u3000", "a", "it's", ".", "7", "\ufdd0", "\ufdd1 ", "é"]), max_size=14))
def test_white_space_runs_and_marks(parts):
    check("".join(parts))
    assert "".join(bpe.pieces("".join(parts))) == "".join(parts)


def test_texts_without_spaces_do_not_fill_the_cache():
    rng = np.random.default_rng(6)
    coder = bpe.Tokenizer(PATH)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 400))) + "。" + "x" * 300 for _ in range(300)]
    for k in range(0, 300, 50):
        for text, ids in zip(texts[k : k + 50], coder.encode(texts[k : k + 50])):
            assert ids.tolist() == THEIRS.encode(text, add_special_tokens=False).ids
    assert len(coder.known) < 50 and coder.held < 50_000
    words = [" ".join(f"w{k}x{j}" for j in range(2000)) for k in range(20)]
    before, bpe.CACHED_BYTES = bpe.CACHED_BYTES, 1 << 20
    try:
        for w in words:
            assert coder.encode([w])[0].tolist() == THEIRS.encode(w, add_special_tokens=False).ids
            assert coder.held < (1 << 20) + 500_000 and sum(200 + 8 * len(s) for s in coder.known) < 3 << 20
    finally:
        bpe.CACHED_BYTES = before


def test_added_tokens_with_conditions_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"] = [*spec.get("added_tokens", []), {"id": 60000, "content": "<x>", "lstrip": True}]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Tokenizer(str(tmp_path / "t.json"))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(bpe.tokenizer_path("word_bpe_49k.json"))
