"""Text columns against plain Python models."""

import re

from pyspark.sql import functions as F

from siltseek.functions import lexicon as L, text as T, topics


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_words_and_identifiers(spark):
    assert one(spark, T.words("t"), t="Get the 2nd userID, naïve x1") == ["get", "the", "nd", "userid", "na", "ve", "x1"]
    assert one(spark, T.split_identifier("t"), t="getUserIDFromHTTPServer") == ["get", "user", "id", "from", "http", "server"]
    assert one(spark, T.split_identifier("t"), t="__snake_case_v2") == ["snake", "case", "v2"]
    assert one(spark, T.split_identifier("t"), t="") == []


def test_stem(spark):
    cases = {"operations": "oper", "running": "runn", "cities": "city", "boxes": "box", "es": "es", "bed": "bed", "sing": "sing", "ways": "way"}
    df = spark.createDataFrame(list(cases.items()), "w string, s string")
    assert {r.w: r.x for r in df.select("w", T.stem("w").alias("x")).collect()} == cases


def test_query_terms_keep_duplicates(spark):
    got = one(spark, T.query_terms("t"), t="The largest integers, integers of a tree")
    assert got == ["largest", "max", "integers", "int", "map", "split", "integer", "integers", "int", "map", "split", "integer", "tree", "parent", "children", "root", "dfs"]


def test_query_views(spark):
    text = "Find  the sum.\r\n\r\n\r\n\r\n-----Input-----\n n numbers\n\n-----Output-----\none number\n-----Examples-----\n1 2\n-----Constraints-----\nn < 5"
    v = one(spark, T.query_views("t"), t=text)
    assert v["statement"] == "Find the sum."
    assert v["full"] == "Find the sum.\n\nn numbers\n\none number\n\nn < 5"
    v = one(spark, T.query_views("t"), t="Do it.\nInput:\na line\nNote\nnothing")
    assert (v["full"], v["statement"]) == ("Do it.\n\na line", "Do it.")
    v = one(spark, T.query_views("t"), t="where is   it used?")
    assert v["full"] == v["statement"] == "where is it used?"
    v = one(spark, T.query_views("t"), t="-----Input-----\nonly")
    assert v["statement"] == "-----Input-----\nonly"
    v = spark.sql("select cast(null as string) t").select(T.query_views("t").alias("v")).first()["v"]
    assert v["full"] == v["statement"] == ""


def test_clean_code(spark):
    assert one(spark, T.clean_code("t"), t="\n a\t\r\nb  \u00a0\r\n\n\n\nc\n") == "a\nb\n\nc"
    long = "h" * 700 + "m" * 2000 + "t" * 400
    got = one(spark, T.clean_code("t", 1000), t=long)
    assert got == long[:650] + "\n...\n" + long[-350:]


def plain_terms(code):
    """A model of code_terms."""
    camel, out = re.compile(L.CAMEL_BOUNDARY), []
    for name in re.findall(L.IDENTIFIER, code):
        parts = [w.lower() for chunk in name.split("_") if chunk for w in camel.split(chunk) if w]
        low = name.lower()
        out += [low] if low not in L.CODE_NOISE and len(low) > 1 else []
        if len(parts) > 1 or (parts and parts[0] != low):
            out += [p for p in parts if len(p) > 1 and p not in L.CODE_NOISE]
    said = re.findall(L.BLOCK_COMMENT, code, re.S) + re.findall(L.STRING_LITERAL, code, re.S)
    said += [m.group(2) for m in (re.search(L.LINE_COMMENT, line) for line in code.split("\n")) if m]
    return out + [w.lower() for w in re.findall(L.WORD, "\n".join(said)) if w.lower() not in L.STOPWORDS and len(w) > 1]


def test_code_terms(spark):
    code = 'def getUserID(self, _x):\n    """Doc string\n here"""\n    url = "http://a.b//c"  # the user name\n    return self.user_id // 2 /* block\n comment */\n'
    assert one(spark, T.code_terms("t"), t=code) == plain_terms(code)
    assert spark.sql("select cast(null as string) t").select(T.code_terms("t").alias("x")).first()["x"] == []


def test_code_terms_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.code_terms("text").alias("x")).collect()
    assert all(r.x == plain_terms(r.text) for r in rows)


def test_hash_and_keys(spark):
    a, b = (one(spark, T.content_hash("t"), t=t) for t in ("f()\n  x  \ny\n\n", "f()\n  x\ny"))
    assert a == b and len(a) == 16
    import hashlib

    assert one(spark, T.cache_key("m", "doc", "t"), t="é") == hashlib.sha1("m|doc|é".encode()).hexdigest()


def test_titles_instructions_prefixes(spark):
    assert one(spark, T.with_title("a", "b"), a="T", b="body ") == "T body"
    assert one(spark, T.with_title("a", "b"), a="", b="body ") == "body "
    assert one(spark, T.with_instruction("a", "b"), a="q", b="do") == "q do"
    assert one(spark, T.prefixed("a", "query_full", "Q: ", "D: "), a="x") == "Q: x"
    assert one(spark, T.prefixed("a", "doc", "Q: ", "D: "), a="x") == "D: x"
    assert one(spark, T.preview("a", 2), a="\n  \nx\n\ny" + "z" * 200 + "\nw").split("\n")[1] == "      | y" + "z" * 99


def test_topics(spark):
    q = one(spark, topics.topic_map(topics.query_topics(F.col("t"))), t="shortest PATH in a graph of cities")
    assert q["graph"] > 1.3 and q["dp"] == 0
    tags = one(spark, topics.top_tags(topics.code_topics(F.col("t"))), t="visited = set()\ndef dfs(x):\n    dp[x] = memo\n")
    assert tags == ["graph", "dp"]
    zero = F.array(*[F.lit(0.0)] * 13)
    assert one(spark, topics.topic_similarity(zero, topics.query_topics(F.col("t"))), t="graph") == 0
    same = one(spark, topics.topic_similarity(topics.query_topics(F.col("t")), topics.query_topics(F.col("t"))), t="graph tree")
    assert abs(same - 1) < 1e-12
