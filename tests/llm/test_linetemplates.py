import random
from collections import defaultdict

import pytest
import xxhash

from millrace.llm import linetemplates as L

from .conftest import edge_rows, sentence

DEPTH, ALIKE = 3, 0.8


def plain(rows):
    """Texts left of each row, by the definition (groups by leaders are modelled for leaves of two lines)."""
    docs = {(i, t or ""): None for i, t in rows}
    units, whole = [], set()
    for d in docs:
        n = 0
        for x in d[1].split("\n"):
            parts = L.parts_of(x)
            for part, own in parts:
                if own:
                    units.append((d, n, tuple("<*>" if any(c in "0123456789" for c in w) else w for w in part.split())))
                    n += 1
                    whole |= {units[-1][2]} if len(parts) == 1 else set()
    leaves = defaultdict(set)
    for _, _, t in units:
        leaves[len(t), t[:DEPTH]].add(t)
    template = {t: t for _, _, t in units}
    for own in leaves.values():
        own &= whole
        for t in own:
            alike = [o for o in own if o == t or sum(a == b for a, b in zip(o, t, strict=True)) >= ALIKE * len(t)]
            assert len(alike) == len(own) or len(alike) == 1, "leaves where some lines are alike aren't modelled"
            template[t] = min(alike)
    groups = defaultdict(list)
    for d, n, t in units:
        groups[template[t]].append((d, n))
    gone = set()
    for g in groups.values():
        if len({d for d, _ in g}) > 1:
            place = lambda x: (x[0][0] is None, x[0][0] or 0, L.signed(spark_hash(x[0][1])), x[1])
            gone |= set(g) - {min(g, key=place)}

    def left(i, t):
        out, n = [], 0
        for x in t.split("\n"):
            keep, lost = [], False
            for part, own in L.parts_of(x):
                lost = own and ((i, t), n) in gone
                keep += [] if lost else [part]
                n += own
            if keep:
                out.append("".join(keep).rstrip() if lost else "".join(keep))
        return "\n".join(out)

    return sorted(str((i, None if t is None else left(i, t))) for i, t in rows)


def spark_hash(text):
    """Spark's xxhash64 of one string."""
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def test_equals_brute_force(spark, edge, empty):
    rows = edge_rows() + [(300 + k, f"{sentence(50 + k, 12)}\nrequest {k} took {k * 7} ms on host-{k}.example and then ended\nshort line\n{sentence(77, 20)}") for k in range(8)]
    rows += [(320 + k, f"the error code for user {name} was set in the log of today again") for k, name in enumerate(("ann", "bob", "cy"))]
    rows += [(330, "alone again here and now\nalone again here and now"), (331, f"{sentence(90, 9)}\n{sentence(91, 9)}")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, `key of 0` int, leaf string").repartition(3)
    out = L.without_recurring_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == plain(rows)
    by = {r.doc_id: r.text for r in got}
    assert len(by[303].split("\n")) == 1 and by[320] and not by[321] and by[330].count("alone") == 2
    assert L.without_recurring_lines(empty).count() == 0
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.without_recurring_lines(df, counts=True).collect()}
    assert counts[303] == (4, 3) and counts[200] == (0, 0)


@pytest.mark.parametrize("n", [3, 20, 1000])
def test_near_copies_get_one_template_at_any_group_size(spark, n):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    word = lambda k: "edit" + "".join(chr(97 + int(d)) for d in str(k))
    # Each copy edits another word, or the same place with another word; its field values recur in other copies.
    rows = [(k, " ".join(words[:3] + [word(k // 3) if j == 3 + k % 17 else w for j, w in enumerate(words) if j > 2])) for k in range(n)]
    rows += [(5000 + k, " ".join(words[:3] + [word(9000 + 50 * k + j) for j in range(17)])) for k in range(3)]  # same leaf, not alike
    got = {r.doc_id: r.text for r in L.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [k for k, t in got.items() if t and k < 5000] == [0]
    assert all(got[5000 + k] for k in range(3))


def test_lines_join_the_template_that_a_group_generalises_to(spark):
    fields, base = (5, 8, 11, 14, 17), [f"w{chr(97 + k)}" for k in range(20)]
    line = lambda new: " ".join(new.get(j, w) for j, w in enumerate(base))
    # Any two of these are alike, and each field differs in four of ten; the next ones are like none of them.
    rows = [(k, line({fields[k % 5]: f"x{chr(97 + k)}", fields[(k + 1) % 5]: f"y{chr(97 + k)}"})) for k in range(10)]
    rows += [(10 + k, line({j: f"z{chr(97 + k)}{chr(97 + j)}" for j in fields})) for k in range(3)]
    rows += [(20, line({j: "other" for j in (*fields, 10)}))]  # the field at 10 is a constant
    got = {r.doc_id: r.text for r in L.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sorted(k for k, t in got.items() if t) == [0, 20]


def test_parts_are_cut_alike_wherever_they_stand():
    passage = "Once more the quiet ferry came over the water. No. It had been late for years on end! And so on, and so on it went."
    alone = [p.strip() for p, own in L.parts_of(passage) if own]
    inside = [p.strip() for p, own in L.parts_of(f"First there was something else here. {passage} Then the day went on as it does.") if own]
    assert len(alone) == 3 and set(alone) <= set(inside)
    for line in (passage, "", "   ", "one", "a. b. c.", " x  y. ", "no end " * 400, "wait... " * 90, "He said \"so it is not here.\" (And so it was not.) Then"):
        assert "".join(p for p, _ in L.parts_of(line)) == line
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(120))  # no marks at all
    alone = {p.strip() for p, own in L.parts_of(long) if own}
    inside = {p.strip() for p, own in L.parts_of("other words come first " * 20 + long + " and after it some" * 20) if own}
    assert len(alone) > 3 and len(alone & inside) >= len(alone) - 2


def test_passages_inside_longer_lines(spark):
    passage = " ".join(f"{sentence(900 + k, 9).capitalize()}." for k in range(6))
    rows = [(k, f"{sentence(100 + k, 12)}. {passage} {sentence(200 + k, 8)}.") for k in range(7)] + [(9, sentence(300, 30)), (9, sentence(301, 30))]
    got = [(r.doc_id, r.text) for r in L.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    texts = dict(got)
    assert texts[0] == rows[0][1] and len(got) == 9
    for k in range(1, 7):
        assert len(texts[k].split()) < 40 and sentence(100 + k, 12) in texts[k] and sentence(200 + k, 8) in texts[k]
    assert sorted(t for i, t in got if i == 9) == sorted(t for i, t in rows if i == 9)
