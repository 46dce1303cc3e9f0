"""Whole feedback texts against a plain rendering."""

from __future__ import annotations

import json

from strophe.operators import feedback as fb


def plain(rows):
    """Summary and items of one recording from (word, idx, target, assessed, flagged, p, text)."""
    words = sorted({r[0] for r in rows})
    own = {w: [r for r in rows if r[0] == w] for w in words}
    name = {w: json.dumps(min(own[w], key=lambda r: r[1])[6] or "", ensure_ascii=False) for w in words}
    hit = {w: sorted((r for r in own[w] if r[3] and r[4]), key=lambda r: r[1]) for w in words}
    review = sorted((w for w in words if hit[w]), key=lambda w: (-max(r[5] for r in hit[w]), w))
    n_assessed, n_hit = sum(r[3] for r in rows), sum(map(len, hit.values()))
    if n_hit:
        text = fb.FLAGGED % (n_hit, n_assessed, len(review))
    else:
        text = fb.CLEAR % n_assessed if n_assessed else fb.NOTHING
    text += f" {len(rows) - n_assessed} target sound(s) were not assessed."
    gaps = [w for w in words if not hit[w] and any(not r[3] for r in own[w])]
    if gaps:
        text += " Unassessed words: " + ", ".join(f"word {w + 1} {name[w]}" for w in gaps) + "."
    if len(review) > 3:
        text += " This message focuses on 3 of the flagged words."
    items = [fb.ITEM % (w + 1, name[w], ", ".join(f"/{t}/" for t in dict.fromkeys(r[2] for r in hit[w]))) for w in review[:3]]
    return "\n\n".join([text, *items])


def test_feedback_texts(spark):
    cases = {
        1: [(0, 0, "K", True, True, 0.9, 'say "hi"'), (0, 1, "K", True, True, 0.95, "x"), (1, 2, "T", True, False, 0.1, "two\\"), (2, 3, "S", False, True, 0.9, "three"), (2, 4, "S", True, False, 0.2, "three")],
        2: [(w, w, "AA", True, True, p, f"w{w}") for w, p in enumerate((0.5, 0.9, 0.9, 0.7, 0.6))],
        3: [(0, 0, "B", False, False, 0.1, None), (1, 1, "B", False, False, 0.1, "naïve 漢")],
        4: [(0, 0, "B", True, False, 0.1, "ok")],
    }
    rows = [(e, *r) for e, rs in cases.items() for r in rs]
    df = spark.createDataFrame(rows, "event long, word long, idx long, target string, assessed boolean, flagged boolean, p_error double, text string").repartition(3)
    got = {r["event"]: r for r in fb.feedback_text(df, "event", "word").collect()}
    assert {e: got[e]["text"] for e in cases} == {e: plain(rs) for e, rs in cases.items()}
    assert [got[e]["intro_id"] for e in (1, 2, 3, 4)] == ["review", "review", "unassessed", "no_flag"] and got[2]["n_items"] == 3
    assert fb.feedback_text(df.where("false"), "event", "word").count() == 0
