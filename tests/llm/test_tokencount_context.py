"""Edits whose effect reaches back over white space or a contraction."""

import pytest

from rainframe.llm import tokencount
from rainframe.llm.tokens import tokenizer_path


@pytest.mark.parametrize("leaf", [1, 2, 64])
@pytest.mark.parametrize(
    "text, start, added",
    [("foo\n\nbar baz", 5, " two new words, 42"), ("it'rx", 4, "edited "), ("it'r", 4, "e"), ("it'lx", 4, "l "), ("it'rx", 3, "v"), ("a \t \n  b", 7, "\n"), ("a" + " " * 200 + "b", 201, "\n"), ("x\u3000\u2028 y", 4, "\n\n z")],
)
def test_context_before_an_edit(monkeypatch, leaf, text, start, added):
    monkeypatch.setattr(tokencount, "LEAF", leaf)
    to = tokencount.Counter.get(tokenizer_path("byte_bpe_50k.tiktoken"))
    chars, tokens, _ = tokencount.build(to, text)
    got = tokencount.apply_edits(to, text, chars, tokens, [{"start": start, "length": 0, "text": added}])
    assert got.text == text[:start] + added + text[start:]
    assert got.tokens == len(to.encoding.encode_ordinary(got.text))
