"""Properties that hold for any text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from planweave.llm import lookalikes, moderation, packing, pieces

texts = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_appearance_is_idempotent(text):
    once = lookalikes.appearance(text)
    assert lookalikes.appearance(once) == once
    assert lookalikes.image(lookalikes.image(once)) == lookalikes.image(once)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("水火a1 。，\n！.é́‍️\r；"), min_size=900, max_size=4000))
def test_pieces_cover_any_text(text):
    spans = pieces.spans(text)
    rebuilt, end = "", 0
    for a, b in spans:
        assert b - a <= pieces.LIMIT and a <= end < b or not text
        rebuilt += text[end:b]
        end = b
    assert rebuilt == text
    assert all(b - pieces.OVERLAP <= c < b for (_, b), (c, _) in zip(spans, spans[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_keeps_every_item(sizes):
    bins = packing.pack(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=5))
def test_every_segment_has_grams(lines):
    parts = [s for t in lines for s in moderation.segments(t)]
    if parts:
        bucket, sizes = moderation.grams(parts)
        assert len(sizes) == len(parts) and sizes.min() > 0 and sizes.sum() == len(bucket)
