from tokenizers import Tokenizer

from reviewlens.llm import packing


def test_white_space_around_known_and_new_chunks():
    """Chunks are looked at only when they are new, and one with white space at its edge is never kept."""
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    texts = ["a b c", "a b\n c", "a b", "a  b c", " a b", "a b ", "a\n b", "a \nb", "a\n", "\n", "", " ", "x <|endoftext|> y", "a b  c", "1.5 été \U0001f600"]
    for text in texts + texts[::-1]:
        coded = encode(text)
        assert [int.from_bytes(coded[i : i + encode.width.itemsize], "little") for i in range(0, len(coded), encode.width.itemsize)] == plain.encode(text, add_special_tokens=False).ids


def test_tasks_of_one_worker_share_an_encoder():
    """Tables were read and chunks encoded anew in every task."""
    assert packing._encoder(packing.default_tokenizer()) is packing._encoder(packing.default_tokenizer())
