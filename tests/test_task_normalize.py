"""task_normalize reads whole texts: what stands after the 60th character counts too."""

import re

from sessionloom.functions import text as T
from sessionloom.plans import mining

TEXTS = ["fix" + "!" * 80 + " bug", "release" + " " * 70, "  " + "words and notes " * 9 + "Status Reports", "_" * 90 + "unit/tests", "Fix the bugs in " * 400 + "glasses", "#" * 70, "Docs", "", None]


def brute(text):
    s = re.sub(r"[_/]+", " ", (text or "").lower().strip())
    s = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]+", "", s)).strip()
    if not s:
        return "uncategorized"
    s = re.sub(r"\b(\w+?)s\b", lambda m: m[1] if len(m[1]) > 3 and not re.search("(ss|us|is)$", m[0]) else m[0], s)
    return next((name for pattern, name in T.TASK_TYPES if re.search(pattern, s)), s)


def test_whole_text_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(7, "Bug/Fix")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.id: r for r in mining.task_normalize(spark, str(tmp_path)).collect()}
    assert out[7].label == "bug fix" and len(out) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS, 100):
        label = brute(text)
        assert (out[i].raw, out[i].label) == ((text or "").strip(), label), text
        assert out[i].slug == (re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", label)) or "uncategorized")
