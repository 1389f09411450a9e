"""The plain-text path must agree with the library on every character that it takes."""

import unicodedata

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Regex, Tokenizer, pre_tokenizers

from quire.llm.bpe import SAFE_RANGES, PreTokenizer, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_safe_character_alone_and_between_letters():
    raw = open(PATH, encoding="utf-8").read()
    library, pre = Tokenizer.from_str(raw), PreTokenizer(raw)
    split = pre_tokenizers.Split(Regex(pre._source), "removed", invert=True)
    chars = [chr(c) for a, b in SAFE_RANGES for c in range(a, b + 1)]
    assert not pc.any(odd_texts(pa.array(chars))).as_py()
    bad = []
    for c in chars:
        assert unicodedata.normalize("NFC", c) == c and unicodedata.combining(c) == 0, hex(ord(c))
        t = f"a{c}{c}b 1{c}'s"
        want = [w for w, _ in split.pre_tokenize_str(library.normalizer.normalize_str(t))]
        offsets, places, units, single = pre.block(pa.array([t]))
        got = [w for k in places for w in pre.parts(units[k])]
        if got != want or single or pre.words(t) != want:
            bad.append((hex(ord(c)), got, want))
    assert not bad, bad[:5]


def test_nfc_does_not_join_safe_neighbours():
    chars = [chr(c) for a, b in SAFE_RANGES for c in range(a, b + 1)]
    text = "".join(chars)
    assert unicodedata.normalize("NFC", text) == text
    for c in chars:
        assert unicodedata.normalize("NFC", "a" + c) == "a" + c and unicodedata.normalize("NFC", "가" + c) == "가" + c
