import public_tokenizers
import pyarrow as pa
import pytest

from pointstrata.llm import token_links, tokens
from pointstrata.llm.queries import BYTE_BPE, PIECE_BPE


@pytest.mark.parametrize("name", [BYTE_BPE, PIECE_BPE])
def test_the_mark_for_a_space_inside_a_text(name):
    texts = ["▁ 1", "a ▁b", "▁", "a▁ ▁ b, c."]
    enc = tokens.prefixed(public_tokenizers.path(name))
    ids, off = enc.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [list(enc._whole(t)) for t in texts]


def test_later_passes_hold_no_encoders():
    a, b = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    kinds = [("<u2" if tokens.prefixed(x).size <= 1 << 16 else "<u4") for x in (a, b)]
    sizes = token_links.without_encoders(a, b)
    assert tokens.prefixed.cache_info().currsize == 0 and [len(s) > 30_000 for s in sizes] == [True, True]
    assert [token_links.id_type(x) for x in (a, b)] == kinds and tokens.prefixed.cache_info().currsize == 0
