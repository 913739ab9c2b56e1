"""Replay of saved summaries, read in place where they are installed.

A summary file lists a group's sentences and the summary made of them, so the
listed sentences must give exactly the listed summary, in order.
"""

import os
from collections import defaultdict
from pathlib import Path

import pytest

from gistmill.operators import terms
from gistmill.plans import summarize as plans
from gistmill.session import stage

FOLDER = Path(os.environ.get("SUMMARY_FILES", "no-such-folder"))
HEAD, CUT = "Original Response: \n", "\nSummary: \n"


def saved():
    by_folder = defaultdict(dict)
    for path in FOLDER.rglob("*.txt"):
        text = path.read_text(encoding="utf-8", errors="replace")
        if text.startswith(HEAD) and CUT in text:
            source, summary = text[len(HEAD):].split(CUT, 1)
            by_folder[path.parent][path.name] = ([s for s in source.split("\n") if s], [s for s in summary.split("\n") if s])
    return by_folder


def replayed(spark, files, share):
    rows = [(*key, i, s) for key, (source, _) in files.items() for i, s in enumerate(source)]
    parts = spark.createDataFrame(rows, "folder string, name string, sen_pos int, part string")
    sentences = stage(terms.with_bag(terms.describe_sentences(parts, "part")), "replay")
    got = defaultdict(list)
    for r in plans.summarize_sentences(sentences, ["folder", "name"], [], share=share).orderBy("folder", "name", "rank").collect():
        got[(r.folder, r.name)].append(r.sentence)
    return got


def test_own_saved_summary(spark, tmp_path):
    # Scores by hand: "gate" is in three sentences and rare in none of them, so the
    # sentence of frequent terms only comes first, then the next shortest.
    source = [
        "Gate gate opens gate wide now.", "Quiet gardens keep several lonely foxes warm.",
        "Gate opens gate gate slowly here.", "Nobody counted seven purple wooden boats there.",
    ]
    path = tmp_path / "one.txt"
    path.write_text(HEAD + "\n".join(source) + CUT + source[2] + "\n" + source[0] + "\n")
    text = path.read_text()
    body, summary = text[len(HEAD):].split(CUT)
    got = replayed(spark, {("f", "n"): (body.split("\n"), None)}, 0.5)
    assert sorted(got[("f", "n")]) == sorted(summary.split("\n")[:-1])


@pytest.mark.skipif(not FOLDER.exists(), reason="no saved summaries here")
def test_saved_summaries(spark):
    exact = {}
    for share in (0.15, 0.30):
        files = {(str(f), n): v for f, group in saved().items() for n, v in group.items()}
        got = replayed(spark, files, share)
        for key, (_, summary) in files.items():
            exact.setdefault(key[0], {}).setdefault(share, []).append(got[key] == summary)
    whole = {folder: max(sum(v) for v in shares.values()) for folder, shares in exact.items()}
    sizes = {folder: len(shares[0.15]) for folder, shares in exact.items()}
    # Two folders hold one sentence per line and replay in full; the others keep
    # line breaks inside sentences, which a line-based reading cannot restore.
    full = [f for f in sizes if whole[f] == sizes[f] and sizes[f] > 1]
    assert sorted(sizes[f] for f in full) == [56, 187]
