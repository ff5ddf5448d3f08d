"""Properties of the operators' cores on generated inputs; no session needed."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import decontaminate, hashing, html_extract, language_id, lm_score, media, near_dedup, token_counts, toxicity

TEXT = st.text(max_size=200)
WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40)
RELAXED = settings(max_examples=60, deadline=None)


@RELAXED
@given(st.lists(WORDS, max_size=4), WORDS)
def test_automaton_equals_windows(items, words):
    own = decontaminate.Automaton([(str(i), w) for i, w in enumerate(items)])
    hit, found = set(), set()
    for i, w in enumerate(items):
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    spans, got = own.match(words)
    assert {x for a, b in spans for x in range(a, b)} == hit and {own.items[i] for i in got} == found
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    return token_counts.Counter(token_counts.read_vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@RELAXED
@given(st.lists(TEXT, max_size=5))
def test_tokens_equal_the_library(tokenizer, texts):
    assert tokenizer[0].count(texts) == [len(tokenizer[1].encode(t, num_threads=1)) for t in texts]


@RELAXED
@given(st.binary(max_size=500))
def test_media_round_trip(raw):
    payload = media.payload_of(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(raw)] == raw and not any(payload[len(raw) :])
    assert media.from_png(media.to_png(payload, len(raw))) == (payload, len(raw))


@RELAXED
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(0, 2**40), max_size=50))
def test_packed_counts_round_trip(held):
    keys = np.array(sorted(held), dtype=np.uint64)
    counts = np.array([held[int(k)] for k in keys], dtype=np.uint64)
    a, b = lm_score.unpack_counts(lm_score.pack_counts(keys, counts))
    assert (a == keys).all() and (b == counts).all()


@RELAXED
@given(TEXT)
def test_shingles_follow_the_words(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "replace").translate(hashing.FOLD))
    want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    assert len(near_dedup.shingle_set(text.encode("utf-8", "replace"))) == len(want)
    assert len(hashing.word_hashes(text.encode("utf-8", "replace"))) == len(words)


@RELAXED
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<b>", "<!--", "-->", "<script>", "</script>", "<ul><li>", "text, more", "&amp;", "<", "'", '"', "<br>", "<article>", "</article>", "\n"]), max_size=30))
def test_pages_of_any_shape(parts):
    out = html_extract.extract("".join(parts))
    assert out == "\n".join(" ".join(b.split()) for b in out.split("\n")) and "\n\n" not in out


@RELAXED
@given(TEXT)
def test_folded_letters(text):
    points = language_id.folded(text)
    assert (points > 0).sum() == sum(c.isalpha() for c in text)
    assert sum(len(p) for p in language_id.pieces(points)) == len(points)
    for t in (text, text.encode("ascii", "ignore").decode()):
        assert toxicity.words_of(t) == re.findall(r"[^\W_]+", t.lower())
