import random
import re

import regex

from stridelake.llm import surrogates as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, type string, norm int"
PII = {
    "email": ["anna.19@mail5.example.com", "b+c_d@sub.host.co.uk"],
    "phone": ["+1 (743) 555-3824", "(020) 555-1234", "743-555-3824", "+49 30 5551 2345"],
    "ip": ["70.23.22.57", "227.5.221.1"],
    "card": ["4785380592391139", "4111 1111 1111 1111"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "secret": ['04dbebab91ab85687d33eeaaf9ac699e1188f962'],
    "name": ["Mrs. Anna Smith", "Herr Müller", "Господин Иванов", "Κυρία Παππά"],
}


def mention(kind, value):
    return f'token = "{value}"' if kind == "secret" else value


def test_types_formats_and_coreference(spark):
    rows, all_of = [], [(k, v) for k, vs in PII.items() for v in vs]
    for n, (k, v) in enumerate(all_of):
        rows.append((n, f"Before {mention(k, v)} after. {mention(k, v)}!!", "en", "s", 1, "x", 2))
    rows.append((100, "MAIL ANNA.19@MAIL5.EXAMPLE.COM!! and 4111111111111111", "en", "s", 1, "x", 2))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {(r.type, r.entity) for r in P.detect(docs.where("doc_id < 100")).collect()} == {(k, v) for k, v in all_of}
    got = {r.doc_id: r.text for r in P.replace(docs).collect()}
    new = {}
    for n, (k, v) in enumerate(all_of):
        shape = re.fullmatch(r'Before (?:token = ")?(.*?)"? after\. (?:token = ")?(.*?)"?!!', got[n], re.S)
        assert shape, got[n]
        assert shape[1] == shape[2] != v
        new[v] = shape[1]
    assert len(set(new.values())) == len(new)
    for k, v in all_of:
        mask = lambda t: re.sub("[0-9]", "9", t)
        if k in ("phone", "card", "ssn"):
            assert mask(new[v]) == mask(v)
    assert new["+1 (743) 555-3824"].startswith("+1 (")
    assert re.fullmatch(P.PATTERNS["ip"].replace(r"(?<![\d.])", ""), new["70.23.22.57"])
    digits = lambda t: [int(c) for c in t if c.isdigit()]
    luhn = lambda t: sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(digits(t)))) % 10 == 0
    assert luhn("4111 1111 1111 1111") and luhn(new["4111 1111 1111 1111"])
    assert digits(new["4111 1111 1111 1111"]) == digits(got[100].split(" and ")[1])
    assert got[100].split(" ")[1].removesuffix("!!") == new["anna.19@mail5.example.com"].upper()
    assert new["Mrs. Anna Smith"].startswith("Mrs. ") and len(new["Mrs. Anna Smith"].split()) == 3 and new["Mrs. Anna Smith"].split()[1].endswith("na")
    assert re.fullmatch("Господин [а-яА-Я]+", new["Господин Иванов"]) and re.fullmatch("Κυρία [α-ωΑ-Ως]+", new["Κυρία Παππά"])
    other = {r.doc_id: r.text for r in P.replace(docs, "another key").collect()}
    assert all(other[n] != got[n] for n in got)


def test_clean_texts_stay_and_edges(spark):
    clean = ["Plain text.", "Version 3. 1999 and 12, 3.14 1.2.3", "x@y", "", None, "a token of thanks", "1" * 30, "word " * 40000, "$1$ \\1 (7) 5%"]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(clean)]
    pii = "7.7.7.7 and a@b.org " * 3000
    rows += [(50, pii, "en", "s", 1, "t", 3), (50, pii, "en", "s", 1, "t", 3), (None, "7.7.7.7", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = P.replace(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    same = {r.doc_id: r.text for r in got if r.doc_id is not None and r.doc_id < 50}
    assert same == dict(enumerate(clean))
    twice = [r for r in got if r.doc_id == 50]
    ip = next(r.text for r in got if r.doc_id is None)
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].text.startswith(ip + " and ") and "7.7.7.7" not in twice[0].text
    assert P.replace(docs.limit(0)).collect() == []


def test_collisions_are_resolved(spark):
    """Four-digit secrets have few surrogates; all must still differ."""
    values = random.Random(1).sample(range(1000, 9999), 300)
    table = spark.createDataFrame([("secret", str(v)) for v in values], "type string, norm string")
    got = P.assign(table).collect()
    assert len({r.surrogate for r in got}) == len(got) == 300
    assert not {r.surrogate for r in got} & {str(v) for v in values}


def test_forms_of_one_name(spark):
    text = "Mrs. Anna Smith came. Mrs. Smith left. Anna Smith slept, Smith said. Mr. Max Smith and Smithson. Herr Meier-Schulz! Anna"
    docs = spark.createDataFrame([(1, text), (2, "Anna Smith and Smith, no title: they stay."), (3, "Frau Anna Lang\x01Anna Lang \x01")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.replace(docs).collect()}
    shape = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. Mrs\. (\w+) left\. (\w+) (\w+) slept, (\w+) said\. Mr\. (\w+) (\w+) and Smithson\. Herr (\w+)! Anna", got[1])
    anna, smith, *rest = shape.groups()
    assert rest[:4] == [smith, anna, smith, smith] and rest[5] == smith and anna.endswith("na") and rest[4].endswith("rin")
    assert len({anna, smith, rest[4], rest[6]}) == 4 and not {anna, smith, rest[4], rest[6]} & {"Anna", "Smith", "Max", "Meier-Schulz"}
    assert got[2] == "Anna Smith and Smith, no title: they stay."
    third = re.fullmatch("Frau (\\w+ \\w+)\x01(\\w+ \\w+) \x01", got[3])
    assert third[1] == third[2] and third[1].split()[0] == anna


def test_more_names_than_short_surrogates(spark):
    """Names beyond what three syllables can tell apart still differ."""
    table = spark.range(40_000).selectExpr("'family' as type", "concat('N', lower(hex(id))) as norm")
    got = P.assign(table)
    assert got.select("surrogate").distinct().count() == 40_000
    assert got.where("surrogate rlike '[^A-Za-z]'").isEmpty()


def test_long_secrets_and_clashing_columns(spark):
    rows = [(1, "token=" + "a1B2" * 200 + " x", "k", 5), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "_row long, text string, _Parts string, _new int")
    out = P.replace(docs)
    assert out.columns == docs.columns
    got = {r._row: r for r in out.collect()}
    new = got[1].text[6:-2]
    assert len(new) == 800 and new != "a1B2" * 200 and re.fullmatch("([a-z][0-9][A-Z][0-9])+", new) and got[1]._new == 5 and got[2].text is None


def test_against_brute_force_on_a_table(spark):
    """Found by another engine's regular expressions, cut and put together in
    Python: pieces stay, and one mapping, one to one, explains all mentions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in P.replace(docs).collect()}
    any_, title = regex.compile(P.ANY), regex.compile(P._TITLE)
    new, found = {}, 0
    for i, text in before.items():
        spans, names = [m.span() for m in any_.finditer(text)], set()
        for a, b in spans:
            if title.match(text[a:b]):
                full = title.sub("", text[a:b])
                names |= {full, full.split(" ")[-1]}
        if names:
            bare = regex.compile(r"(?<!\p{L})(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")(?!\p{L})")
            edges = [0, *(x for s in spans for x in s), len(text)]
            spans = sorted(spans + [(m.start() + a, m.end() + a) for a, b in zip(edges[::2], edges[1::2]) for m in bare.finditer(text[a:b])])
        edges = [0, *(x for s in spans for x in s), len(text)]
        shape = "(.*?)".join(regex.escape(text[a:b]) for a, b in zip(edges[::2], edges[1::2]))
        got = regex.fullmatch(shape, after[i], regex.S)
        assert got, i
        for (a, b), v in zip(spans, got.groups()):
            assert new.setdefault(text[a:b], v) == v != text[a:b]
        found += len(spans)
    assert found > 50 and len(set(new.values())) == len(new) and not set(new.values()) & set(new)
