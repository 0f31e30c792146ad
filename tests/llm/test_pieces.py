"""Round trips, the model's own segmentation without dropout, and a plain encoder of whole texts."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from netquarry.llm import pieces as P

MODEL = P.load()
TEXTS = ["", "a", "Hello world, hello  world!", "tab\tline\n\nend ", " leading", "naïve façade ▁ marks ▁▁", "日本語 text 🙂", "x" * 3000, "the the the of the", "\x00 control", "ab" * 70 + "ing " * 40]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def encode(text, dropout=P.DROPOUT, seed=P.SEED, key=""):
    return P.Encoder(MODEL, dropout, seed).encode([text], [key])[0]


def plain(text, dropout, seed, key):
    """The whole text as one agenda: scans all neighbours for the best candidate that its draw does not skip."""
    if not text:
        return []
    text, limit, doc = " " + text, round(dropout * 2**32), np.array([P.document_key(seed, key)])
    shown = ["<literal>" if c == P.SPACE else P.SPACE if c == " " else c for c in text]
    parts = [(i, i + 1) for i in range(len(text))]
    drawn = {}

    def skipped(*at):
        if at not in drawn:
            drawn[at] = int(P.draws(doc, *[np.array([x]) for x in at])[0]) < limit
        return drawn[at]

    word = lambda a, b: "".join(shown[a:b])
    while True:
        found = [(-MODEL.ids[word(a, d)][1], a, b, d) for (a, b), (_, d) in zip(parts, parts[1:]) if word(a, d) in MODEL.ids and not skipped(a, b, d)]
        if not found:
            break
        _, a, b, d = min(found)
        i = parts.index((a, b))
        parts[i : i + 2] = [(a, d)]
    return [i for a, b in parts for i in ([MODEL.ids[word(a, b)][0]] if word(a, b) in MODEL.ids else [MODEL.byte[x] for x in text[a:b].encode("utf-8", "surrogatepass")])]


def test_without_dropout_the_pieces_are_the_models_own():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for t in ["Hello world, hello world!", "the cat sat on the mat", "supercalifragilistic unbelievable 12345 ééé", "aaaa" * 40]:
        assert ids_of(encode(t, 0.0)) == sp.encode(t)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_decoding_gives_every_text_back(text):
    text = text.encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass")
    assert P.decode(MODEL, encode(text, 0.3, 7, "k")) == text


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_whole_texts_are_those_of_the_plain_encoder(dropout):
    words = ["unbelievable internationalisation, of été 2024!", "aaaaaaa  b\n\n c▁d", "日本 naïve", "abcdeaeiou" * 9 + " x", "ing" * 40]
    got = P.Encoder(MODEL, dropout, 3).encode(words, [str(i) for i in range(len(words))])
    assert [ids_of(x) for x in got] == [plain(t, dropout, 3, str(i)) for i, t in enumerate(words)]


@given(st.text(alphabet="abeinrst é\n▁", max_size=40), st.sampled_from([0.05, 0.3]))
@settings(max_examples=60, deadline=None)
def test_random_texts_are_those_of_the_plain_encoder(text, dropout):
    assert ids_of(encode(text, dropout, 5, "d")) == plain(text, dropout, 5, "d")


def test_every_occurrence_is_drawn_anew():
    """One long word in 300 documents: many cuts; one without dropout."""
    word = "internationalisation"
    apart = P.Encoder(MODEL).encode([word] * 300, [str(i) for i in range(300)])
    assert len(set(apart)) > 10 and len(set(P.Encoder(MODEL, 0.0).encode([word] * 300, [str(i) for i in range(300)]))) == 1
    rate = np.mean(P.draws(np.array([P.document_key(1, str(i)) for i in range(20_000)]), np.full(20_000, 3), np.full(20_000, 4), np.full(20_000, 6)) < 0.1 * 2**32)
    assert abs(rate - 0.1) < 0.01


def test_seeds_differ_and_repeat():
    text = " ".join(["international understanding"] * 50)
    one, two = encode(text, 0.3, 1, "d"), encode(text, 0.3, 2, "d")
    assert one != two and one == encode(text, 0.3, 1, "d") and one != encode(text, 0.3, 1, "e")
    assert P.decode(MODEL, one) == P.decode(MODEL, two) == text


def test_spans_and_batches_change_nothing(monkeypatch):
    texts = [" ".join(f"word{i % 37} other{i % 11}" for i in range(500)), "x" * 300, "", "日本語" * 100, "short"]
    keys = list("abcde")
    want = P.Encoder(MODEL).encode(texts, keys)
    monkeypatch.setattr(P, "SPAN", 50)
    assert P.Encoder(MODEL).encode(texts, keys) == want and [P.decode(MODEL, x) for x in want] == texts


def test_table(spark):
    rows = [(i, t, "kept") for i, t in enumerate([*TEXTS, None])] + [(None, "no key", "x"), (0, "", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "ids AS decoded", "ids AS n_pieces")
    got = P.round_trip(df, MODEL).collect()
    assert len(got) == len(rows) and all(r.text == r.decoded for r in got)
    assert all((r.ids is None) == (r.text is None) for r in got)
    apart = P.decode_pieces(P.encode_pieces(df, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.ids or b"") for r in apart) == sorted((str(r.doc_id), r.ids or b"") for r in got)
    assert P.round_trip(df.limit(0), MODEL).count() == 0
