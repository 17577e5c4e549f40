from cohortlens.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, mask string, perspective string"


def test_odd_conversations(text_spark):
    rows = [
        (1, 2, "bob", "second"), (1, 1, "ann", "first"), (1, 3, "ann", "third"), (1, 0, "system", "be kind"),
        (1, 3, "ann", "third"), (2, 1, None, "who"), (2, 2, "eve", None), (3, 1, "system", "alone"),
        (None, 1, "ann", "x"), (4, None, "ann", "x"), (5, 300, "zoe", "late"), (5, 1, "zoe", ""),
    ]
    frame = text_spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = {(r.conv_id, r.chunk, r.perspective): r for r in chat.rotate(frame).collect()}
    assert set(out) == {(1, 0, "ann"), (1, 0, "bob"), (2, 0, "eve"), (5, 0, "zoe"), (5, 1, "zoe")}
    ann = out[1, 0, "ann"]
    assert ann.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nfirst<|im_end|>\n"
        "<|im_start|>user name=bob\nsecond<|im_end|>\n<|im_start|>assistant\nthird<|im_end|>\n"
    )
    assert [ann.text[a:b] for a, b in ann.mask] == ["first", "third"]
    assert [out[1, 0, "bob"].text[a:b] for a, b in out[1, 0, "bob"].mask] == ["second"]
    eve = out[2, 0, "eve"]
    assert eve.text == "<|im_start|>user\nwho<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [eve.text[a:b] for a, b in eve.mask] == [""] and eve.n_masked == 1
    assert chat.report(chat.rotate(frame.limit(0))).count() == 0


def test_long_conversation_is_cut(text_spark):
    rows = [(7, i, f"p{i % 3}", f"turn {i}", "", "") for i in range(1000)]
    out = chat.rotate(text_spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 3 * 4 and sum(r.n_masked for r in out) == 1000
    for r in out:
        assert all(r.text[a:b].startswith("turn ") for a, b in r.mask)
