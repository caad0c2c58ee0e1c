"""WordPiece tokens against a tokenizer library, round trips, and blank tiles."""

import random

import pytest
from pyspark.sql import functions as F

from hearken.functions.wordpiece import SPECIAL, WordPiece, basic_words
from hearken.operators import calls
from hearken.plans.engine import Engine

VOCABULARY = [*SPECIAL, "a", "b", "ab", "abc", "##a", "##b", "##bc", "##c", "the", "un", "##aff", "##able", ".", ",", "'", "##", "금", "##융", "금융", "漢", "n't", "s", "don", "t"]


def test_longest_pieces_from_the_left():
    piece = WordPiece(VOCABULARY)
    said = lambda text: [VOCABULARY[k] for k in piece.ids(text)]
    assert said("abca unaffable. the") == ["abc", "##a", "un", "##aff", "##able", ".", "the"]
    assert said("abd") == ["[UNK]"] and said("금융금") == ["[UNK]"] and said("금융") == ["금융"]
    assert said("a,漢b") == ["a", ",", "漢", "b"] and said("") == [] and said("[UNK]") == ["[UNK]"] * 3
    assert said("a" * 101) == ["[UNK]"] and len(said("a" * 100)) == 100
    assert WordPiece(VOCABULARY, lower=True).ids("ABC") == piece.ids("abc")


def test_equals_a_library():
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer(tokenizers.models.WordPiece({p: k for k, p in enumerate(VOCABULARY)}, unk_token="[UNK]", max_input_chars_per_word=100))
    whole.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.BertPreTokenizer()])
    whole.normalizer = tokenizers.normalizers.BertNormalizer(clean_text=False, handle_chinese_chars=True, strip_accents=False, lowercase=False)
    piece, rng = WordPiece(VOCABULARY), random.Random(0)
    for _ in range(600):
        text = "".join(rng.choice(["a", "b", "c", "ab", "the", " ", " ", "'", ".", ",", "금", "융", "漢", "é", "Q", "-", "…", "un", "able"]) for _ in range(rng.randint(0, 30)))
        assert piece.ids(text) == whole.encode(text, add_special_tokens=False).ids, text


def test_decoding_leaves_out_special_tokens_and_spaces():
    piece = WordPiece(VOCABULARY)
    assert piece.text(piece.ids("unaffable , don ' t .")) == "unaffable, don't."
    assert WordPiece(VOCABULARY, clean=False).text(piece.ids("ab . zz a")) == "ab . a"
    assert piece.text([1, 2, 3, 999, -1]) == ""
    for text in ("abc the unaffable", "금융 ab"):
        assert piece.text(piece.ids(text)) == text


def test_words_of_a_text():
    assert list(basic_words("  it's a-b\t[x]  ")) == ["it", "'", "s", "a", "-", "b", "[", "x", "]"]


def test_columns_and_blank_tiles(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(VOCABULARY) + "\n", encoding="utf-8")
    piece = WordPiece.from_file(spark, str(tmp_path / "vocab.txt"))
    assert piece.vocabulary == VOCABULARY
    rows = [(0, "the abc the"), (1, None), (2, ""), (3, "the ab zz zz zz zz the"), (4, "zz zz zz"), (5, "zz " * 9)]
    df = spark.createDataFrame(rows, "k int, said string")
    ids = piece.encode(F.col("said"))
    got = {r.k: r for r in df.select("k", ids.alias("ids"), piece.decode(ids).alias("back"), piece.tiles(F.col("said"), 4).alias("tiles")).collect()}
    assert got[0].ids == piece.ids("the abc the") and got[0].back == "the abc the" and got[0].tiles == ["the abc", "the"]
    assert (got[1].ids, got[1].back, got[1].tiles) == (None, None, None) and got[2].tiles == [""]
    assert got[3].tiles == ["the ab", "the"]  # what lies between is unknown, so blank
    assert got[4].tiles == [] and got[5].tiles == []
    with pytest.raises(ValueError):
        piece.tiles(F.col("said"), 2)
    with pytest.raises(ValueError):
        WordPiece(["a", "a", "[UNK]"])
    with pytest.raises(ValueError):
        WordPiece(["a"])


def test_calls_are_scored_by_tiles_of_pieces(spark):
    """The scorer sees pieces' tiles: the longest of them decides."""
    scorer = calls.per_tile(lambda t: F.array(F.lit(0.0), F.length(t) * 1.0))
    chunks = spark.createDataFrame([("a", 0, 0.0, 1.0, "the abc the unaffable ab")], "call_id string, chunk_index int, start double, end double, transcript string")
    engine = Engine(scorer=scorer, tiler=lambda t: WordPiece(VOCABULARY).tiles(t, 5))
    row = engine.analyze(chunks).first()
    assert row.suspicion_score == pytest.approx(1 / (1 + 2.718281828459045 ** -len("the abc the")))
