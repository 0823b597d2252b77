import random
import re

from gridloom.llm import oracles, rules as R
from verify import compare

from .odd import no_docs, odd_docs, rows


def by_definition(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def base(df):
    return [(r.id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept, r.failed_rules) for r in R.apply_rules(df).collect()]


def test_odd_documents(spark):
    got = base(odd_docs(spark))
    assert sorted(((str(i), m) for i, m, _, _ in got), key=str) == sorted(((str(i), by_definition(t)) for i, t, *_ in rows()), key=str)
    assert all(not k for _, m, k, _ in got if m[5]) and any(k for _, _, k, _ in got)


def test_random_texts_with_repeats(spark):
    r = random.Random(9)
    texts = []
    for _ in range(150):
        words = [r.choice("ab") for _ in range(r.randint(0, 60))]
        texts.append("".join(w + r.choice([" ", "\n", "\t", "\x0b", "  "]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, m, _, _ in base(df):
        assert m == by_definition(texts[i])


def test_rules_name_their_failures(spark):
    texts = ["the and of words here " * 30, "### *** " * 40 + "the", "THE WHOLE TEXT SHOUTS AND SHOUTS OF IT " * 1 + " ".join(f"WORD{chr(65 + k)}" for k in range(26))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    why = {r.id: set(r.failed_rules) for r in R.apply_rules(df).collect()}
    assert "repeats" in why[0] and {"symbols", "repeats"} <= why[1] and "upper" in why[2]


def test_own_table_of_rules(spark):
    df = spark.createDataFrame([(1, "one two three " + "more words go on " * 3)], "doc_id long, text string")
    none, strict = R.apply_rules(df, ()).first(), R.apply_rules(df, (R.Rule("long", "n_words", 1000, float("inf")),)).first()
    assert none.failed_rules == [] and strict.failed_rules == ["long"] and not strict.kept


def test_no_user_functions(spark):
    plan = R.apply_rules(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert R.apply_rules(no_docs(spark)).count() == 0


def test_oracle_of_odd_documents(spark, tmp_path):
    import duckdb

    odd_docs(spark).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM read_parquet('{tmp_path}/d/*.parquet')")
    cur = con.execute(oracles.rules_sql())
    out = R.apply_rules(odd_docs(spark)).withColumnRenamed("id", "doc_id").drop("failed_rules")
    assert compare((out.columns, [tuple(r) for r in out.collect()]), ([d[0] for d in cur.description], cur.fetchall())) == ""
