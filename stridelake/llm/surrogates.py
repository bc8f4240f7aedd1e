"""PII surrogates: keyed, type-consistent replacements, in DataFrame functions only.

One regular-expression pass cuts each text into pieces and entities; a second
one, only over texts with a titled name, finds that name where it stands without
its title.  Entities are normalised (coreferent spellings meet in one form), a
person's name is a given and a family name, and the distinct forms get a
surrogate from a keyed digest: same type, same letter and digit classes, for
given names the gender their title tells, for all names their script.  So
"Mrs. Anna Smith", "Mrs. Smith", "Anna Smith" and "Smith" stay one person.  A
collision check over all surrogates gives what collides, or equals a detected
form, further attempts until all differ; later attempts are longer.  Each text
is then put together again, every mention in the format it was written in.

Edge cases: null text stays null; a text without an entity stays as it is;
equal entities get equal surrogates wherever they occur; repeated rows stay
repeated; an empty table gives an empty result; extra columns are kept whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import materialize, small_side, unused

#: The default key only serves tests; real runs pass their own secret.
KEY = "stridelake"
#: Attempts in an entity's own format; later ones grow longer.
ROUNDS = 24
MARK = "\x01"

# Titles that announce a name, with the gender they tell.
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"]
TITLES_M = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = "[A-Za-z0-9+/_=.-]"
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9+/_.-])(?<=(?i:token|secret|password|passwd|api.?key|access.?key)[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?){_SECRET}{{8,}}+",
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}})*\.[A-Za-z]{{2,24}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\d.+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|(?<=\+\d{1,3}[ .-]?)\d{2,4}[ .-]|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(TITLES_F + TITLES_M)})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?:[ -]\p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
#: What a text with an entity must hold; the cheap first look.
HINT = rf"[0-9@]|(?i:token|secret|passw|key)|(?:{'|'.join(TITLES_F + TITLES_M)})\.? \p{{Lu}}"

# Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ka", "ke", "la", "le", "lo", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vi"],
    "cyrillic": ["ба", "бе", "бо", "да", "де", "до", "фа", "фе", "га", "ка", "ке", "ла", "ле", "ло", "ма", "ме", "ми", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "ва", "ве", "ви"],
    "greek": ["βα", "βε", "βο", "δα", "δε", "δο", "φα", "φε", "γα", "κα", "κε", "λα", "λε", "λο", "μα", "με", "μι", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε", "το", "ζα", "ζε", "ζι"],
}
ENDINGS = {"latin": ("na", "rin"), "cyrillic": ("на", "рин"), "greek": ("να", "ρος")}


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return "array(" + ", ".join(map(_q, values)) + ")"


def kind(entity: str) -> str:
    """SQL: the type of a match."""
    title = "|".join(TITLES_F + TITLES_M)
    digits = f"char_length(regexp_replace({entity}, '[^0-9]', ''))"
    return f"""case when {entity} rlike {_q(rf"^(?:{title})\.? \p{{Lu}}")} then 'name'
      when {entity} rlike {_q("^" + _LOCAL + "+@")} then 'email'
      when {entity} rlike {_q(f"^{_OCTET}(?:[.]{_OCTET}){{3}}$")} then 'ip'
      when {entity} rlike {_q("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$")} then 'iban'
      when {entity} rlike {_q("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")} then 'ssn'
      when {entity} rlike {_q("^[0-9]([ -]?[0-9])+$")} and {digits} >= 13 then 'card'
      when {entity} rlike {_q("^[+(0-9][0-9 ().-]+$")} and {digits} between 9 and 15 then 'phone'
      else 'secret' end"""


def normal(entity: str, type_: str) -> str:
    """SQL: one form for all spellings of an entity."""
    return f"""case {type_} when 'email' then lower({entity}) when 'iban' then replace({entity}, ' ', '')
      when 'phone' then regexp_replace({entity}, '[^0-9]', '') when 'card' then regexp_replace({entity}, '[^0-9]', '')
      else {entity} end"""


def surrogate(key: str) -> str:
    """SQL over ``type, norm, attempt``: the surrogate in normal form."""
    inner = f"sha2(concat({_q(key)}, '|', type, '|', attempt, '|', norm), 256)"
    stream = "concat(" + ", ".join(f"sha2(concat({_q(key)}, '|{n}|', {inner}), 256)" for n in range(8)) + ")"
    byte = lambda i: f"cast(conv(substr(s, 2 * (({i}) % 256) + 1, 2), 16, 10) as int)"
    masked = f"""array_join(transform(split({{0}}, ''), (c, i) -> case when c between '0' and '9' and char_length(c) = 1 then cast({byte('i')} % 10 as string)
        when c rlike '^[a-f]$' and type = 'secret' then substr('abcdef', {byte('i')} % 6 + 1, 1)
        when c rlike '^[a-z]$' then substr('abcdefghijklmnopqrstuvwxyz', {byte('i')} % 26 + 1, 1)
        when c rlike '^[A-Z]$' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {byte('i')} % 26 + 1, 1) else c end), '')"""
    script = "case when norm rlike '\\\\p{IsCyrillic}' then 'cyrillic' when norm rlike '\\\\p{IsGreek}' then 'greek' else 'latin' end"
    # Three syllables, more with each attempt: no number of names uses them up.
    syllables = lambda script_: f"array_join(transform(sequence(0, 2 + least(attempt, 60)), k -> {_list(SYLLABLES[script_])}[{byte('k')} % 32]), '')"
    ending = lambda script_: f"case type when 'given_f' then {_q(ENDINGS[script_][0])} when 'given_m' then {_q(ENDINGS[script_][1])} else '' end"
    name = "case " + " ".join(f"when {script} = '{n}' then initcap(concat({syllables(n)}, {ending(n)}))" for n in SYLLABLES) + " end"
    body = f"concat(substr(norm, 1, 1), {masked.format('substr(norm, 2, char_length(norm) - 2)')})"
    card = f"if(luhn_check(norm), filter(transform(sequence(0, 9), d -> concat({body}, d)), x -> luhn_check(x))[0], concat({body}, {byte(60)} % 10))"
    spread = f"case when char_length(norm) > 10 then concat(substr(norm, 1, char_length(norm) - 10), cast(2 + {byte(20)} % 8 as string), substr({masked.format('norm')}, char_length(norm) - 8)) else {masked.format('norm')} end"
    ip = f"concat_ws('.', 1 + {byte(0)} % 223, {byte(1)}, {byte(2)}, 1 + {byte(3)} % 254)"
    local = "concat(regexp_replace(split(norm, '@')[0], '[^a-z0-9._-]', ''), substr(s, 101, 3))"
    email = f"concat({masked.format(local)}, '@', substr(s, 111, 6), '.example.', {_list(['com', 'org', 'net'])}[{byte(50)} % 3])"
    iban = f"concat(substr(norm, 1, 2), {masked.format('substr(norm, 3)')})"
    longer = f"if(attempt < {ROUNDS}, '', concat('-', substr(s, 201, 4 + least(attempt - {ROUNDS}, 60))))"
    return f"transform(array({stream}), s -> case when type in ('given_f', 'given_m', 'family') then {name} else concat(case type when 'email' then {email} when 'ip' then {ip} when 'card' then {card} when 'phone' then {spread} when 'iban' then {iban} else {masked.format('norm')} end, {longer}) end)[0]"


def in_format(entity: str, type_: str, norm: str) -> str:
    """SQL: the surrogate ``norm`` written as ``entity`` is."""
    pick = "[^0-9A-Z]"
    inside = lambda end: f"char_length(regexp_replace({end}, '{pick}', ''))"
    filled = f"concat(array_join(transform(split({entity}, ''), (c, i) -> if(c rlike '^[0-9A-Z]$', substr({norm}, {inside(f'substr({entity}, 1, i + 1)')}, 1), c)), ''), substr({norm}, {inside(entity)} + 1))"
    return f"""case {type_} when 'phone' then {filled} when 'card' then {filled} when 'iban' then {filled}
      when 'email' then if({entity} = upper({entity}), upper({norm}), {norm}) else {norm} end"""


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, type, entity``: every mention in the texts."""
    found = docs.where(F.col("text").rlike(HINT)).select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, {_q(ANY)}, 0)")).alias("entity"))
    return found.select("doc_id", F.expr(kind("entity")).alias("type"), "entity")


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``type, norm, surrogate`` for distinct ``entities(type, norm)``: all
    surrogates of a type differ from each other and from its entities."""
    made = F.expr(surrogate(key))
    entities = materialize(entities.select("type", "norm").distinct().withColumn("attempt", F.lit(0)), "entities")
    taken = entities.select("type", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    current = entities.withColumn("surrogate", made)
    while True:
        order = Window.partitionBy("type", "surrogate").orderBy(F.desc("attempt"), "norm")
        ranked = current.withColumn("place", F.row_number().over(order)).join(taken, ["type", "surrogate"], "left")
        current = materialize(ranked.select("type", "norm", "attempt", "surrogate", ((F.col("place") > 1) | F.col("real").isNotNull()).alias("again")), "surrogates")
        if current.where("again").isEmpty():
            return current.select("type", "norm", "surrogate")
        current = current.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).withColumn("surrogate", F.when(F.col("again"), made).otherwise(F.col("surrogate"))).drop("again")


_TITLE = rf"^(?:{'|'.join(TITLES_F + TITLES_M)})\.? "
_FEMALE = rf"^(?:{'|'.join(TITLES_F)})\.? "


def cut(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs``, written, with three more columns and their names: a row number;
    the text's parts, pieces and entities in turn; and ``form, gender`` of the
    names in it.  Where there are parts ``text`` is null."""
    row, parts, names, mark = unused(docs, "_row", "_parts", "_names", "_mark")
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    split = lambda text, pattern: f"split(regexp_replace({text}, {pattern}, concat({mark}, '$0', {mark})), {mark}, -1)"
    forms = f"""transform(array(struct(regexp_replace(e, {_q(_TITLE)}, '') as form, if(e rlike {_q(_FEMALE)}, 'f', 'm') as gender)), n ->
        if(instr(n.form, ' ') > 0, array(n, struct(substring_index(n.form, ' ', -1) as form, n.gender as gender)), array(n)))[0]"""
    # A text that holds the mark itself gets one it cannot hold.
    rows = docs.withColumn(mark, F.expr(f"if(contains(text, {_q(MARK)}), concat({_q(MARK)}, substr(sha2(text, 256), 1, 32)), {_q(MARK)})"))
    rows = rows.select(*own, "text", mark, F.expr(f"if(text rlike {_q(HINT)}, {split('text', _q(ANY))}, null)").alias(parts))
    rows = rows.select("*", F.expr(f"if(size({parts}) > 1, array_distinct(flatten(transform(filter({parts}, (x, i) -> i % 2 = 1 and x rlike {_q(_TITLE)}), e -> {forms}))), null)").alias(names))
    bare = f"concat('(?<!\\\\p{{L}})(?:', array_join(transform(array_sort(transform({names}, n -> struct(-char_length(n.form) as k, n.form as form))), n -> n.form), '|'), ')(?!\\\\p{{L}})')"
    rows = rows.select("*", F.expr(f"if(size({names}) > 0, {bare}, null)").alias(mark + "b"))
    again = f"flatten(transform({parts}, (x, i) -> if(i % 2 = 1, array(x), {split('x', mark + 'b')})))"
    rows = rows.select(*own, "text", F.expr(f"if({mark}b is not null, {again}, {parts})").alias(parts), names)
    some = F.coalesce(F.size(parts) > 1, F.lit(False))
    rows = rows.select(*own, F.when(~some, F.col("text")).alias("text"), F.when(some, F.col(parts)).alias(parts), F.when(some, F.col(names)).alias(names), F.monotonically_increasing_id().alias(row))
    return materialize(rows, "parts"), row, parts, names


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; all columns are kept."""
    rows, parts = _replace(docs, key)
    return rows.drop(parts)


def _replace(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``docs`` with surrogates and a column, whose name it gives, that holds
    the parts its text had been cut to."""
    rows, row, parts, names = cut(docs)
    private = rows.where(F.col(parts).isNotNull())
    mentions = private.select(F.col(row).alias("row"), F.col(names).alias("names"), F.explode(F.expr(f"array_distinct(filter({parts}, (x, i) -> i % 2 = 1))")).alias("entity"))
    mentions = mentions.withColumn("bare", F.expr("get(filter(names, n -> n.form = entity), 0).gender"))
    mentions = mentions.select("row", "entity", F.expr(f"if(bare is not null, 'bare', {kind('entity')})").alias("type"), "bare")
    mentions = mentions.select("row", "entity", "type", F.expr(f"case type when 'bare' then bare when 'name' then if(entity rlike {_q(_FEMALE)}, 'f', 'm') else '' end").alias("gender"))
    entities = materialize(mentions.select("entity", "type", "gender").distinct(), "mentions")
    # A name is a given and a family name; every other entity is one form.
    called = f"regexp_replace(entity, {_q(_TITLE)}, '')"
    forms = f"""if(type in ('name', 'bare'),
        if(instr({called}, ' ') > 0, array(struct(0 as at, concat('given_', gender) as kind, substring_index({called}, ' ', 1) as norm), struct(1 as at, 'family' as kind, substring_index({called}, ' ', -1) as norm)), array(struct(1 as at, 'family' as kind, {called} as norm))),
        array(struct(0 as at, type as kind, {normal('entity', 'type')} as norm)))"""
    forms = entities.select("entity", "type", "gender", F.explode(F.expr(forms)).alias("f")).select("entity", "type", "gender", "f.at", F.col("f.kind").alias("kind"), F.col("f.norm").alias("norm"))
    made = assign(forms.select(F.col("kind").alias("type"), "norm"), key).withColumnRenamed("type", "kind")
    told = forms.join(small_side(made, 128), ["kind", "norm"]).groupBy("entity", "type", "gender").agg(F.max(F.when(F.col("at") == 0, F.col("surrogate"))).alias("s0"), F.max(F.when(F.col("at") == 1, F.col("surrogate"))).alias("s1"))
    title = "if(type = 'name', regexp_extract(entity, '^[^. ]+[.]? ', 0), '')"
    new = F.expr(f"if(type in ('name', 'bare'), concat({title}, concat_ws(' ', s0, s1)), {in_format('entity', 'type', 's0')})")
    told = materialize(told.select("entity", "type", "gender", new.alias("new")), "told")
    lookup = mentions.join(small_side(told, 192), ["entity", "type", "gender"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("new"))
    new, of = unused(rows, "_new", "_of")
    rebuilt = F.expr(f"array_join(transform({parts}, (x, i) -> if(i % 2 = 0, x, {new}[x])), '')")
    out = [F.col(f"`{c}`") for c in docs.columns]
    changed = private.join(lookup.toDF(of, new), F.col(row) == F.col(of)).withColumn("text", rebuilt).select(*out, parts)
    return rows.where(F.col(parts).isNull()).select(*out, parts).unionByName(changed), parts


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, parts = _replace(docs, KEY)
    return rows.select("doc_id", "text", F.expr(f"coalesce((size({parts}) - 1) div 2, 0)").alias("n_entities"))
