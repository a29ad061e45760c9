"""The encoder's pieces: few to ask the library for, and together the encoding of the whole text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm import sstable

MARKS = ("", ",", ".", "!", "?", ";", ":", ")", "...", "'s", '"', "-x")


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole(enc, texts):
    return [e.ids for e in enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_a_word_is_asked_for_once_whatever_stands_around_it(path):
    """Marks after a word and line breaks before it make no more words to encode."""
    words = [f"{a}{b}ière" for a in "bcdfgl" for b in "aeiou"]
    texts = [f"{' '.join(w + m for w in words)}\n{words[k]}{m}\n\n{words[k]}" for k, m in enumerate(MARKS)]
    enc = sstable.Encoder(path)
    assert [x.tolist() for x in enc.encode_batch(texts)] == whole(enc, texts)
    assert len(enc.at) <= 2 * len(words) + 2 * len(MARKS)


def test_every_character_is_cut_as_in_the_whole(path):
    """Beside letters, digits, marks, spaces and line breaks, for all characters of which some bytes are told as letters, and more."""
    texts = [f"a{c},b{c}'s {c}. {c}{c}9 \n{c}\n\n{c}z-{c}\n {c}1{c}\n" for c in map(chr, [*range(0x600), *range(0x2000, 0x2070), 0x3000, 0x65E5, 0x1F642])]
    enc = sstable.Encoder(path)
    assert [x.tolist() for x in enc.encode_batch(texts)] == whole(enc, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ9é×Жз日 \n\t\r.,'s’!-<|>\x1c"), max_size=12), st.sampled_from(["\n\n<|endoftext|>", " <|endoftext|>.", "x<|endoftext|>\n\ny", "q" * 600, " \n" * 300 + "z"])), max_size=8))
def test_texts_of_a_batch_do_not_meet(texts):
    import public_tokenizers

    enc = sstable.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in enc.encode_batch(texts)] == whole(enc, texts)


def test_batches_of_several_groups(path, monkeypatch):
    monkeypatch.setattr(sstable, "GROUP_BYTES", 40)
    enc = sstable.Encoder(path, max_chunks=12, max_chars=100)
    texts = [f"line {k}, then 'it's {k * k}'\n\n" * (k % 3) for k in range(30)] + [None, "日本 " * 40, "end"]
    assert [x.tolist() for x in enc.encode_batch(texts)] == whole(enc, texts)
    assert len(enc.at) <= 12 and enc.chars <= 100


def test_bytes_without_a_token(tmp_path):
    """A vocabulary that lacks some bytes says nothing of where they were; pieces are then encoded one by one."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    some = Tokenizer(models.BPE(vocab={"a": 0, "Ġ": 1, "Ġa": 2, ",": 3}, merges=[("Ġ", "a")]))
    some.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    some.save(str(tmp_path / "some.json"))
    enc = sstable.Encoder(str(tmp_path / "some.json"))
    texts = ["a b, ab a", " b", "ab ba, a é a"]
    assert [x.tolist() for x in enc.encode_batch(texts)] == whole(enc, texts)
