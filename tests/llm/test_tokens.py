import random

import pytest

from maskframe.llm import tokens
from maskframe.llm.tokens import Encoder, tokenizer_file

ODD = [
    "", " ", "  a  b ", "a\n\nb c", "a \n b", "x<|endoftext|> y <|endoftext|>", "İstanbul ΑΣ ΑΣ.", "naïve café Å", "it's I'll 'sx don't  '",
    "日本 語　x", "1²³ ½", "a\x1cb c\x1f d", "😀 😀a", "tab\t x", "µ ª º ß ÿ", "\xa0 a\xa0 b \x85c", "\n", "a\r\n b", "é ́e",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_ids_are_the_library_s(name, stretch, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    encode = Encoder(tokenizer_file(name))
    assert encode.kind
    rnd = random.Random(2)
    letters = "ab 'sté\n\t.,1²Σ日́\xa0\x1c<|endoftext|> I"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    assert [x for x in ODD + made if encode.ids(x) != encode._whole(x)] == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 5)
    encode = Encoder(tokenizer_file("byte_bpe_50k.json"))
    text = " ".join(f"word{i}x" for i in range(100))
    assert encode.ids(text) == encode._whole(text)
    assert len(encode.pieces) <= 5


def test_a_file_of_another_build_is_used_whole(tmp_path):
    import json

    spec = json.load(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    encode = Encoder(str(path))
    assert encode.kind is None
    assert encode.ids("a b  c") == encode._whole("a b  c")


def test_pieces_of_every_ascii_character_are_written_as_the_library_writes_them():
    """Printing pieces only have their spaces replaced; those with control characters are translated."""
    encode = Encoder(tokenizer_file("byte_bpe_50k.json"))
    for piece in [f"{a}x{b}" for a in map(chr, range(128)) for b in ("", " ", "\t", "~", "\x7f", "é")]:
        assert encode._piece(piece) == tokens._little([i.id for i in encode.model.tokenize("".join(encode.letters[b] for b in piece.encode()))])
