import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm.tokens import UnitEncoder
from tapeloom.llm.wordtable import WordTable

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
PARTS = ["a", "Zb", "é", "É", "ß", "×", "÷", "ÿ", "À", "Þ", ",", ".", "###", "|", "$$", "'s", "’", "-", "1", "42", " ", "  ", "\n", "\t", "\x0b", "\r", "\0", "\x1c", "\x85", "\xa0", " ", "é", "́", "İ", "Σ", "ς", "ﬁ", "K", "日本", "🙂", "\"", "x" * 23, "y" * 24, "ö" * 12, "Ö" * 13, "z" * 150, "<|endoftext|>", "<|endoftext", "<|STARTOFTEXT|>"]


def ids_of(table: WordTable, texts: list) -> list[list[int]]:
    ids, sizes = table.encode([None if x is None else x.encode() for x in texts], 1)
    assert sizes.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("bits, limit", [(20, 600_000), (4, 600_000), (8, 50)])
def test_any_text_has_the_library_ids(bits, limit):
    rnd = random.Random(bits + limit)
    texts = ["".join(rnd.choice(PARTS) + rnd.choice(["", "", " "]) for _ in range(rnd.choice([0, 1, 2, 5, 40]))) for _ in range(1500)] + [None, "", " ", "\0", "a\0", "a", "a\0\0 a"]
    t, table = Tokenizer.from_file(PATH), WordTable(UnitEncoder(SPEC), bits, limit)
    for i in range(0, len(texts), 70):
        some = texts[i : i + 70]
        assert ids_of(table, some) == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in some]
    assert table.held <= limit + 70 * 40


def test_other_tokenizers_are_asked_text_by_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, table = Tokenizer.from_file(path), WordTable(UnitEncoder(open(path, encoding="utf-8").read()))
    texts = ["Two words,  and blanks ", None, "é"]
    assert ids_of(table, texts) == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    ids, sizes = table.encode([], 1)
    assert len(ids) == len(sizes) == 0


def test_the_model_is_asked_once_for_a_word_in_all_its_forms():
    enc = UnitEncoder(SPEC)
    asked, model = [], enc.model
    enc.model = lambda word: asked.append(word) or model(word)
    table = WordTable(enc)
    for text in ("Word word, WORD.", "word### Word| wörd", "WÖRD, word"):
        ids_of(table, [text])
    assert len(asked) == 2
