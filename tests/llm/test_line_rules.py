import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from stridelake.llm import line_rules as R
from tests.oracle import compare, views

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, row long, _kept string, _frequent long, _id long"


def slow_base(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_and_line_limits(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abc") for _ in range(k))
    texts = [None, "", " \n\t", "a b", "a a a a", "x y z x y z", "é$ #|　\x1c\x85 q"]
    texts += [" ".join(word(rng.choice([1, 1, 8])) for _ in range(rng.choice([3, 60, 300]))) for _ in range(40)]
    texts += ["\n".join([f"Shared  LINE {k}", *[word(9) + " " + word(9) for _ in range(40)], "dup dup", "dup dup"]) for k in range(60)]
    texts += ["\n".join([" ".join(f"boiler{k}x" for k in range(70)), word(12)]) for _ in range(60)]
    texts.append("many words " * 40000)
    rows = [(i, t, "en", None if i % 50 == 0 else f"s{i % 2}", 1, "clash", 2, "x", 3, 4) for i, t in enumerate(texts)]
    rows.append(rows[60])
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sorted(R.judge(docs).collect(), key=lambda r: (r.doc_id, r.row))
    for r, row in zip(got, sorted(rows, key=lambda x: x[0])):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_base(row[1]), row[1]
    assert 0 < sum(r.lost_lines > 0 for r in got)
    assert all(r.kept == (not r.base_failed and r.lost_words <= 0.5 * r.n_words) for r in got)
    assert any(not r.kept and not r.base_failed for r in got) and any(r.kept and r.lost_lines for r in got)
    out = R.clean(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in got if r.kept}
    cleaned = out.collect()
    assert {r.doc_id for r in cleaned} == kept
    assert any("Shared" in (rows[i][1] or "") for i in kept) and not any("Shared" in r.text for r in cleaned if r.source)
    assert R.judge(docs.limit(0)).collect() == []


def test_oracle(spark):
    con = views("/root/testdata/sf0.001")
    assert compare(R.op8_line_rules(spark, "/root/testdata/sf0.001"), R.ORACLE_SQL, con) > 0


def test_oracle_with_frequent_lines(spark, tmp_path):
    rng = random.Random(5)
    text = lambda k: "\n".join(["Read more  about us", *[" ".join(rng.choices("abcdefghij", k=9)) for _ in range(8)], *["Read more about 12 us"] * (k % 3), *[' '.join(f'w{chr(97 + j % 26)}{chr(97 + j // 26)}' for j in range(150))] * (k % 3 == 0)])
    rows = [{"doc_id": i, "text": None if i == 9 else text(i), "lang": "en", "source": None if i % 2 else "s", "n_chars": 1} for i in range(200)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    df = R.op8_line_rules(spark, str(tmp_path))
    compare(df, R.ORACLE_SQL, views(str(tmp_path)))
    assert df.where("lost_lines > 0").count() > 100 and df.where("not base_failed and not kept").count() > 0
