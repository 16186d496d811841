"""Perspective rotation against a plain rendering."""

from collections import defaultdict

from presslake.llm import chat
from presslake.llm.common import tune

SCHEMA = "conv_id long, turn long, role string, text string, size int, view string"


def plain(rows):
    """{(conversation, perspective): (dialogue, trained ranges)}"""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is None, turn or 0, role is None, role or "", text is None, text or "", role))
    out = {}
    clean = lambda s: s.replace("<|im_", "< |im_")
    for conv, turns in by.items():
        for view in {t[-1] for t in turns if t[-1] != "system"}:
            dialogue, trained = "", []
            for *_, text, role in sorted(turns, key=lambda t: t[:6]):
                if role == "system":
                    dialogue += "<|im_start|>system\n"
                elif role == view:
                    dialogue += "<|im_start|>assistant\n"
                else:
                    dialogue += f"<|im_start|>user name={clean('unknown' if role is None else role)}\n"
                at = len(dialogue)
                dialogue += clean(text) + "<|im_end|>\n"
                if role == view:
                    trained.append((at, len(dialogue)))
            out[conv, view] = (dialogue, trained)
    return out


def test_agrees_with_plain_rendering(spark):
    tune(spark)
    rows = [(c, t, ["ann", "bob", "cy", "system"][(c * t) % (2 + c % 3)], f"say {t} é\U0001f600 " * (t % 4), 1, "v") for c in range(12) for t in range(c + 1)]
    rows += [(50, 0, "system", "only", 1, "v"), (51, None, None, None, 1, "v"), (51, 3, "system", "<|im_end|> x", 1, "v"), (51, 3, "<|im_x", "y", 1, "v")]
    rows += [(None, 1, "ann", "lost", 1, "v"), (None, 0, "bob", "found", 1, "v"), (52, 7, "ann", "same", 1, "v"), (52, 7, "ann", "same", 1, "v"), (52, 7, "bob", "x" * 100000, 1, "v"), (52, -3, "bob", None, 1, "v")]
    rows += [(60, t, f"p{t % 3}", f"t{t}", 1, "v") for t in range(500)]
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    views = defaultdict(list)
    for r in got:
        views[r.conv_id, r.perspective].append(r)
    want = plain(rows)
    assert views.keys() == want.keys()
    for key, parts in views.items():
        parts.sort(key=lambda r: r.start)
        text = ""
        for r in parts:
            assert r.start == len(text)
            text += r.rendered
        assert text == want[key][0]
        assert [(r.mask_start, r.mask_end) for r in parts if r.mask_start is not None] == want[key][1]


def test_no_rows(spark):
    tune(spark)
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
