"""Later windows keep long and late system turns, and a long last turn where there is room."""

import collections

from chronolith.llm import chat_format


def test_long_system_and_last_turns_are_repeated(spark):
    rows = [(1, 0, "system", "s" * 3000), (2, 0, "user", "hello"), (2, 3, "system", "late"), (3, 0, "system", "t" * 9000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{t:03d}" + "w" * (1200 if t % 2 else 400)) for c in (1, 2, 3, 4) for t in range(4, 40)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.windows(conv).collect()
    shown, size = collections.defaultdict(list), collections.Counter()
    for x in sorted(got, key=lambda x: (x.conv_id, x.window, x.pos)):
        shown[x.conv_id, x.window].append(x)
        size[x.conv_id, x.window] += -(-len(x.text.encode()) // 4) + 4
    assert len(shown) > 30
    for (c, w), xs in shown.items():
        assert len({x.pos for x in xs}) == len(xs)
        if c in (1, 3):
            assert xs[0].role == "system" and xs[0].repeated == (w > 0)
        if c != 3:
            assert size[c, w] <= chat_format.BUDGET
        if w > 0:
            before = max((x for x in shown[c, w - 1] if not x.repeated), key=lambda x: x.pos)
            fits = size[c, w] + -(-len(before.text) // 4) + 4 <= chat_format.BUDGET - 256
            assert not fits or any(x.pos == before.pos for x in xs)
    at = next(x.window for x in got if x.text == "late" and not x.repeated)
    assert {x.window for x in got if x.text == "late"} == {w for c, w in shown if c == 2 and w >= at}
    assert any(x.repeated and x.role == "assistant" for x in got)  # turns of 304 tokens
