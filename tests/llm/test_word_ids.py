"""Token ids of words, encoded many at a time, against the tokenizer itself."""
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexloom.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PUNCTUATION = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
ODD = [
    "don't", "x's", "X'S,", "'s", "o'", "a-b", "a1", "1a", "123", "a,b", "...", ",", "end</w>", "</w>", "a<|endoftext|>", "<|endoftext|>,",
    "A<|ENDOFTEXT|>", "İstanbul", "İ,", "K", "Å,", "ŉ", "straße.", "ẞ", "W̊", "ẘ", "é,", "É", "a̸,", "a≮", "ΟΔΟΣ", "ΟΔΟΣ,", "ΟΔΟΣ'",
    "Привет!", "ЙЁ", "й", "中文", "中文，", "한글", "각ᆨ", "ﬁ", "x y", "x　", " ", "\x1c", "a\x1cb", "a​b", "‍", "\U0001f600", "a\U0001f600.",
    "x²", "½", "ª", "º.", "ˈa", "ǅ", "ͅ", "a_b", "_", "٣", "", "a\x00b", "a�", "a" * 5000, "B" * 300 + "!" * 300]


def _same(known: packing.WordIds, tokenizer: Tokenizer, words: list[str]) -> None:
    ids, lengths = known.of(pa.array(words, pa.string()))
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    at = np.r_[0, np.cumsum(lengths)].tolist()
    wrong = [w for w, a, b, x in zip(words, at, at[1:], want) if ids[a:b].tolist() != x]
    assert not wrong and len(lengths) == len(words) and len(ids) == at[-1]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("cached", [0, 40, 600_000])
def test_ids_are_the_tokenizers(monkeypatch, file, cached):
    monkeypatch.setattr(packing, "CACHED_WORDS", cached)
    path = public_tokenizers.path(file)
    known, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    mixed = [w + rng.choice(["", *PUNCTUATION, "?!", "'."]) for w in ODD for _ in range(4)]
    for words in (ODD, [], list(dict.fromkeys(mixed)), ODD[::-1], ["Again", "again", "again,"]):
        _same(known, tokenizer, words)
    assert len(known._known) <= cached


def test_every_letter_and_mark_that_is_cut():
    letters = [chr(c) for c in range(0x80, 0x500) if re.match(packing._CUT, chr(c))]
    assert len(letters) > 400
    known, tokenizer = packing.WordIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    _same(known, tokenizer, letters + [f"x{c}{rand}" for c in letters for rand in ("y", "'", ",.")] + [f"Ab{p}" for p in PUNCTUATION] + [f"É{p}{q}" for p in PUNCTUATION for q in PUNCTUATION])


def test_case_and_punctuation_are_not_encoded_again():
    known, tokenizer = packing.WordIds(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)
    known._tokenizer = Counted()
    rng = random.Random(4)
    stems = list({"".join(rng.choice("abdefiklmnorstué") for _ in range(rng.randint(4, 9))) for _ in range(2000)})
    words = [f(w) + p for w in stems for f in (str, str.title) for p in ("", ",", ".")]
    _same(known, tokenizer, words)
    assert len(asked) < len(words) / 100 and sum(map(len, asked)) < sum(map(len, words)) / 3
