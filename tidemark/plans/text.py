"""Text, answer and clock queries over conversations, documents, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as M
from tidemark.plans.base import EV, events, table

#: Set phrases that turn a turn of a conversation into a question of a format.
ASKS = (
    "Please provide a number.", "Please answer with yes or no.", "Please select one answer: top; middle ;bottom.", "Use the format hh:mm:ss.",
    "Please provide a single integer.", "Name the class or answer with none.", "In %, how many?", "Answer with yes or no and give a reason.",
    "Is the Clip at 00:01:02 one of 3 Clips in the Specimen Bag?", "Are both the Sponges and the Mesh visible at the same time?", "When was the first Needle seen, or the last Gallstone?",
)


def _questions(s, d):
    asks = F.array(*map(F.lit, ASKS))
    q = F.concat_ws(" ", "text", F.element_at(asks, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ASKS))) + 1).cast("int")))
    return table(s, d, "conversations").select("conv_id", "turn", q.alias("q"))


_sql = lambda x: "'" + x.replace("'", "''") + "'"
QS = f"qs as (select conv_id, turn, concat_ws(' ', text, [{', '.join(map(_sql, ASKS))}][(conv_id + turn) % {len(ASKS)} + 1]) as q from conversations)"
#: The expected format of each of ASKS, in their order, for a text that asks for no format itself; the twin
#: states results, not the rules, and falls back on plain searches of words where a text has such a phrase.
EXPECTED = ("number", "binary", "multiple_choice", "time", "open_ended", "fo_class", "percentage", "open_ended", "open_ended", "open_ended", "open_ended")
_L = "lower(q)"
FORM = (
    f"(case when contains({_L}, 'in %') or contains({_L}, 'xx%') or contains({_L}, 'percentage') then 'percentage' when contains({_L}, 'provide a single integer') then 'open_ended' "
    f"else [{', '.join(map(_sql, EXPECTED))}][(conv_id + turn) % {len(ASKS)} + 1] end)"
)


def txt_detect_format(s, d):
    return _questions(s, d).select("conv_id", "turn", X.question_format(F.col("q")).alias("form"))


def txt_topic(s, d):
    return _questions(s, d).select("conv_id", "turn", X.on_topic(F.col("q"), X.question_format(F.col("q"))).alias("topic"))


def txt_options(s, d):
    q = _questions(s, d).select("conv_id", "turn", X.options(F.col("q")).alias("o"))
    return q.where(F.size("o") > 0).select("conv_id", "turn", F.array_join("o", "|").alias("opts"))


def txt_template_fold(s, d):
    return _questions(s, d).groupBy(X.folded(F.col("q")).alias("template")).agg(F.count("*").alias("n"))


def _fold_sql(q):
    out = f"regexp_replace(regexp_replace({q}, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}', '<TS>', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '<N>', 'g')"
    for n in sorted(X.FO_CLASSES, key=lambda n: (-len(n), n)):
        out = f"replace(replace({out}, '{n + ('es' if n.endswith('sh') else 's')}', '<FO>'), '{n}', '<FO>')"
    return f"trim({out})"


def txt_template_key(s, d):
    return table(s, d, "documents").select("doc_id", X.leading_words(F.col("text")).alias("k"))


#: Short words that stand for classes in ``documents``; some are part of others.
WORDS = ("then", "the", "erand", "and", "tion", "tionen", "en")


def txt_entities_longest_first(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(X.entities(F.col("text"), WORDS), ",").alias("hits"))


def _entity_sql():
    names = sorted(WORDS, key=lambda n: (-len(n), n))
    steps, prev = ["e0 as (select doc_id, lower(text) as rest, '' as hits from documents)"], "e0"
    for i, n in enumerate(names, 1):
        steps.append(f"e{i} as (select doc_id, replace(rest, '{n}', ' ') as rest, case when contains(rest, '{n}') then case when hits = '' then '{n}' else hits || ',{n}' end else hits end as hits from {prev})")
        prev = f"e{i}"
    return "with " + ", ".join(steps) + f" select doc_id, hits from {prev}"


def txt_mask_mode(s, d):
    return _questions(s, d).groupBy(X.mask_mode(F.col("q")).alias("mode"), X.edge_kind(F.col("q")).alias("edge")).agg(F.count("*").alias("n"))


def txt_ordinals(s, d):
    return table(s, d, "orders").select("o_orderkey", X.ordinal(F.col("o_orderkey")).alias("nth"))


def txt_path_stem(s, d):
    return table(s, d, "pages").select("page_id", X.stem(F.col("url")).alias("stem"))


def _answers(s, d):
    """Answers of several shapes about a document's id, or about its whole text."""
    fill = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))
    a = F.element_at(F.array(*[F.concat(F.lit(p), fill, F.lit(e)) for p, e in SHAPES]), (F.pmod("doc_id", F.lit(len(SHAPES))) + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", a.alias("a"))


SHAPES = (("about ", "."), ("Yes, it is ", ""), ("NO", "!"), ("no.", ""), ("around ", ".5%"), ("Clip, Sponge., ", ""), ("clip, none; ", ""), ("none.", ""), (" Specimen Bag , Mesh\nx", " y"))
_FILL = "case when doc_id % 2 = 0 then cast(doc_id as varchar) else ' ' || coalesce(text, '') end"
ANS = "an as (select doc_id, [" + ", ".join(f"{_sql(p)} || {_FILL} || {_sql(e)}" for p, e in SHAPES) + f"][doc_id % {len(SHAPES)} + 1] as a from documents)"
_TRAIL = "' ' || chr(9) || chr(10) || '.。、,；;:：!！?？''\"`*'"


def _norm(form):
    return lambda s, d: _answers(s, d).select("doc_id", X.normalised(F.col("a"), form).alias("v"))


def txt_normalize_list(s, d):
    listed = F.regexp_replace("a", "[0-9]+", "")
    return _answers(s, d).select("doc_id", X.normalised(listed, "fo_class").alias("v"))


def txt_normalize_line(s, d):
    listed = F.regexp_replace("a", "[0-9]+", "")
    return _answers(s, d).select("doc_id", X.normalised(listed, "fo_class", first_line=True, unknown=True).alias("v"))


def txt_normalize_changed(s, d):
    rows = _answers(s, d).withColumn("v", X.normalised(F.col("a"), "number"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("v")).alias("changed"))


_KNOWN = "[" + ", ".join(f"'{c.lower()}'" for c in (*X.FO_CLASSES, "none")) + "]"
_PARTS = f"list_filter([trim(p, {_TRAIL}) for p in string_split(t, ',')], lambda x: x <> '')"
_LIST = "with " + ANS + ", b as (select doc_id, {t} as t from an), p as (select doc_id, t, " + _PARTS + " as ps from b), k as (select *, len(ps) > 0 and len(list_filter(ps, lambda x: not list_contains(" + _KNOWN + ", lower(x)))) = 0 as known from p) select doc_id, case when known and list_contains([lower(x) for x in ps], 'none') then 'none' when known then array_to_string(ps, ', ') {more} else t end as v from k"


def txt_word_replace(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("t"))
    return rows.select("doc_id", X.replaced_word(F.col("t"), "the", "mesh").alias("v"))


def txt_distinct_list(s, d):
    rows = table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", ",").alias("t"))
    return rows.select("doc_id", F.coalesce(X.distinct_list(F.col("t")), F.lit("")).alias("v"))


def txt_canonical_list(s, d):
    rows = table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", ",").alias("t"))
    return rows.select("doc_id", X.canonical_list(F.col("t")).alias("v"))


#: Templates of a question and the paraphrases that its parameters may be put into.
PHRASES = ("How many {} are there at {}?", "At {1}, what is the number of {0}?", "Count the {} seen at {}.")


def txt_paraphrase(s, d):
    """Parameters of a templated question found again and put into a template drawn by hash."""
    base = F.concat(F.lit("How many "), F.col("cls"), F.lit("s are there at "), M.hhmmss(F.pmod("sec", F.lit(86400))), F.lit("?"))
    q = events(s, d).select("event_id", base.alias("q"))
    a, b = F.regexp_extract("q", r"^How many (.+) are there at ([0-9:]+)\?$", 1), F.regexp_extract("q", r"^How many (.+) are there at ([0-9:]+)\?$", 2)
    forms = [F.concat(F.lit("How many "), a, F.lit(" are there at "), b, F.lit("?")), F.concat(F.lit("At "), b, F.lit(", what is the number of "), a, F.lit("?")), F.concat(F.lit("Count the "), a, F.lit(" seen at "), b, F.lit("."))]
    pick = F.pmod(F.conv(F.substring(X.seeded("p", F.col("event_id")), 1, 7), 16, 10).cast("long"), F.lit(3))
    return q.select("event_id", F.element_at(F.array(*forms), (pick + 1).cast("int")).alias("v"))


def txt_sentence_dropout(s, d):
    """The first sentence goes for a seeded third of the documents."""
    cut = F.regexp_replace("t", r"^[^.]*\.\s*", "")
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("t"))
    return rows.select("doc_id", F.when(X.coin("drop", F.col("doc_id"), 1 / 3), cut).otherwise(F.col("t")).alias("v"))


def txt_group_map(s, d):
    groups = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    return events(s, d).groupBy(F.coalesce(F.try_element_at(groups, F.col("cls")), F.lit("OTHER")).alias("grp")).agg(F.count("*").alias("n"))


GROUPS = {"view": "PASSIVE", "click": "PASSIVE", "purchase": "ACTIVE", "signup": "ACTIVE"}


def txt_question_family(s, d):
    rules = [("count", r"(?i)^in\b|how many|number"), ("time", r"(?i)when|hh:mm:ss"), ("choice", r"(?i)select"), ("yes_no", r"(?i)yes or no|^are|\bis the\b")]
    return _questions(s, d).groupBy(X.first_match(F.col("q"), rules, "other").alias("family")).agg(F.count("*").alias("n"))


def txt_prompt_assembly(s, d):
    q = _questions(s, d)
    form = X.question_format(F.col("q"))
    hint = F.when(form == "number", "Give digits only.").when(form == "binary", "Say yes or no.")
    return q.select("conv_id", "turn", F.concat_ws("\n", F.lit("You answer questions about a video."), hint, F.concat(F.lit("Format: "), form), F.col("q")).alias("prompt"))


def txt_count_note(s, d):
    """The classes of an hour by falling count: ``2 click, 1 view``."""
    c = events(s, d).groupBy("user_id", "hr", "cls").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "cls", "n")))
    return c.groupBy("user_id", "hr").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["cls"])), ", ").alias("note"))


def txt_route(s, d):
    low = F.lower(F.trim("c_mktsegment"))
    route = F.when(low.contains("auto"), "A").when(F.col("c_mktsegment").rlike("^[BF]"), "B").when(F.col("c_mktsegment").isNull(), "none").otherwise("C")
    return table(s, d, "customer").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def tm_hhmmss(s, d):
    return table(s, d, "lineitem").select((F.col("l_extendedprice") - 2000).alias("x")).distinct().select(F.floor(F.col("x") * 100 + 0.5).alias("x100"), M.hhmmss(F.floor(F.col("x") * 100 + 0.5) / 2).alias("clock"))


def _clocks(s, d):
    """Comma lists of clock times made of an order's keys; some parts are broken."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    one = lambda k: F.concat_ws(":", two(F.pmod(k, F.lit(24))), two(F.pmod(k * 7, F.lit(60))), two(F.pmod(k * 13, F.lit(60))))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    last = F.when(F.pmod(k, F.lit(5)) == 0, "10:00").when(F.pmod(k, F.lit(7)) == 0, "00:00:10.").otherwise(one(k + c))
    return table(s, d, "orders").select("o_orderkey", F.concat_ws(", ", one(k), one(c), last).alias("t"))


def _clock_sql(k):
    return f"lpad(cast(({k}) % 24 as varchar), 2, '0') || ':' || lpad(cast((({k}) * 7) % 60 as varchar), 2, '0') || ':' || lpad(cast((({k}) * 13) % 60 as varchar), 2, '0')"


CK = f"ck as (select o_orderkey, concat_ws(', ', {_clock_sql('o_orderkey')}, {_clock_sql('o_custkey')}, case when o_orderkey % 5 = 0 then '10:00' when o_orderkey % 7 = 0 then '00:00:10.' else {_clock_sql('o_orderkey + o_custkey')} end) as t from orders)"
_SEC = "[cast(string_split(x, ':')[1] as bigint) * 3600 + cast(string_split(x, ':')[2] as bigint) * 60 + cast(string_split(x, ':')[3] as bigint) for x in {l}]"
_joined = lambda c: F.array_join(c.cast("array<string>"), ",")


def txt_anchor_times(s, d):
    return _clocks(s, d).select("o_orderkey", _joined(M.anchors(F.col("t"))).alias("v"))


def txt_time_parse(s, d):
    return _clocks(s, d).select("o_orderkey", _joined(M.strict_times(F.col("t"))).alias("v"))


def tm_loose_parse(s, d):
    return _clocks(s, d).select("o_orderkey", _joined(M.loose_times(F.col("t"))).alias("v"))


def tm_millis(s, d):
    return table(s, d, "orders").select("o_orderkey", M.with_millis(F.concat(F.lit("1:2:3:"), F.pmod("o_orderkey", F.lit(1000)).cast("string"))).alias("v"))


def tm_tolerance(s, d):
    dur = F.pmod("o_orderkey", F.lit(1000))
    return table(s, d, "orders").select("o_orderkey", F.round(M.tolerance(dur), 6).alias("tol"), M.coarse_stride(dur * 3).alias("stride"), M.frames_for_stride(dur, 5.0).alias("frames"), M.size_for_frames(M.frames_for_stride(dur, 5.0), {768: 32, 560: 64, 448: 96}).cast("long").alias("size"))


def tm_clamp_centre(s, d):
    t = M.clamped(M.anchors(F.col("t")), F.lit(3600), F.lit(72000))
    return _clocks(s, d).select("o_orderkey", _joined(t).alias("clamped"), _joined(M.centre(F.sort_array(t), F.lit(1))).alias("mid"))


def tm_linspace(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.posexplode(M.linspace(k.cast("double"), k + 12.0, F.pmod(k, F.lit(5))))).select("o_orderkey", F.col("pos").cast("long").alias("pos"), F.round("col", 6).alias("x"))


def tm_quadrant(s, d):
    x, y = F.pmod("p_partkey", F.lit(100)), F.pmod(F.col("p_partkey") * 37, F.lit(100))
    return table(s, d, "part").groupBy(X.quadrant(x, y, F.lit(100), F.lit(100)).alias("quad")).agg(F.count("*").alias("n"))


def tm_gauss(s, d):
    t = F.pmod("o_orderkey", F.lit(50)).cast("double")
    return table(s, d, "orders").select("o_orderkey", F.round(M.bumps(t, F.array(F.lit(10.0), F.lit(20.0)), 5.0), 6).alias("w"))


def tm_cache_key(s, d):
    return table(s, d, "pages").select("page_id", F.substring(F.sha1(F.concat_ws("|", "url", F.col("page_id").cast("string"))), 1, 20).alias("k"))


_MATCH = f"regexp_extract_all(t, '{X.TIMESTAMP}')"
QUERIES = {
    "txt_detect_format": (txt_detect_format, f"with {QS} select conv_id, turn, {FORM} as form from qs"),
    "txt_topic": (txt_topic, f"with {QS} select conv_id, turn, {FORM} = 'fo_class' or regexp_matches(q, {_sql(X.TOPIC)}) as topic from qs"),
    "txt_options": (txt_options, f"with {QS}, o as (select conv_id, turn, list_filter([trim(x) for x in string_split(rtrim(trim(regexp_extract(q, '(?is)please select[^:]*:\\s*(.+)$', 1)), '.'), ';')], lambda x: x <> '') as o from qs) select conv_id, turn, array_to_string(o, '|') as opts from o where len(o) > 0"),
    "txt_template_fold": (txt_template_fold, f"with {QS} select {_fold_sql('q')} as template, count(*) as n from qs group by 1"),
    "txt_template_key": (txt_template_key, "select doc_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 8), ' ') as k from documents"),
    "txt_entities_longest_first": (txt_entities_longest_first, _entity_sql()),
    "txt_mask_mode": (txt_mask_mode, f"with {QS} select case when regexp_matches(q, '(?i)\\bboth\\b|at the same time|simultaneously|together') then 'and' else 'or' end as mode, case when regexp_matches(q, '(?i)\\bfirst\\b') then 'first' when regexp_matches(q, '(?i)\\blast\\b') then 'last' else 'other' end as edge, count(*) as n from qs group by 1, 2"),
    "txt_ordinals": (txt_ordinals, "select o_orderkey, o_orderkey || case when o_orderkey % 100 between 11 and 13 then 'th' when o_orderkey % 10 = 1 then 'st' when o_orderkey % 10 = 2 then 'nd' when o_orderkey % 10 = 3 then 'rd' else 'th' end as nth from orders"),
    "txt_path_stem": (txt_path_stem, "with a as (select page_id, regexp_replace(url, '^.*/', '') as p from pages) select page_id, case when regexp_matches(p, '^.+\\.[^.]*$') then regexp_replace(p, '\\.[^.]*$', '') else p end as stem from a"),
    "txt_normalize_number": (_norm("number"), f"with {ANS}, b as (select doc_id, trim(a) as t from an) select doc_id, case when regexp_extract(t, '[0-9]+') <> '' then regexp_extract(t, '[0-9]+') else t end as v from b"),
    "txt_normalize_percent": (_norm("percentage"), f"with {ANS}, b as (select doc_id, trim(a) as t from an) select doc_id, case when regexp_extract(t, '[0-9]+(?:\\.[0-9]+)?') <> '' then regexp_extract(t, '[0-9]+(?:\\.[0-9]+)?') else t end as v from b"),
    "txt_normalize_binary": (_norm("binary"), f"with {ANS}, b as (select doc_id, trim(a) as t from an) select doc_id, case when lower(trim(t, {_TRAIL})) in ('yes', 'no') then lower(trim(t, {_TRAIL})) when regexp_extract(lower(t), '^(yes|no)\\b', 1) <> '' then regexp_extract(lower(t), '^(yes|no)\\b', 1) else t end as v from b"),
    "txt_normalize_list": (txt_normalize_list, _LIST.format(t="trim(regexp_replace(a, '[0-9]+', '', 'g'))", more="")),
    "txt_normalize_line": (txt_normalize_line, _LIST.format(t="trim(string_split(trim(regexp_replace(a, '[0-9]+', '', 'g')), chr(10))[1])", more="when len(ps) > 0 and len(list_filter(ps, lambda x: not regexp_full_match(x, '[A-Za-z][A-Za-z /\\-]{0,29}'))) = 0 then array_to_string(ps, ', ')")),
    "txt_normalize_changed": (txt_normalize_changed, f"with {ANS} select count(*) as n, count(*) filter (where a <> case when regexp_extract(a, '[0-9]+') <> '' then regexp_extract(a, '[0-9]+') else trim(a) end) as changed from an"),
    "txt_word_replace": (txt_word_replace, "select doc_id, regexp_replace(regexp_replace(text, '\\bThe\\b', 'Mesh', 'g'), '\\bthe\\b', 'mesh', 'g') as v from documents"),
    "txt_distinct_list": (
        txt_distinct_list,
        "with p as (select doc_id, unnest(string_split(regexp_replace(text, '[^A-Za-z]+', ',', 'g'), ',')) as x, generate_subscripts(string_split(regexp_replace(text, '[^A-Za-z]+', ',', 'g'), ','), 1) as i from documents), f as (select doc_id, i, x from p where x is not null and x <> ''), "
        "k as (select *, row_number() over (partition by doc_id, lower(x) order by i) as k from f), j as (select doc_id, string_agg(x, ', ' order by i) as v from k where k = 1 group by 1) select doc_id, coalesce(v, '') as v from documents left join j using (doc_id)",
    ),
    "txt_canonical_list": (txt_canonical_list, "with p as (select doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ',', 'g'), ','), lambda x: x <> '') as l from documents) select doc_id, array_to_string(list_sort(l), ', ') as v from p"),
    "txt_paraphrase": (
        txt_paraphrase,
        "with " + EV + ", q as (select event_id, cls || 's' as a, lpad(cast((sec % 86400) // 3600 as varchar), 2, '0') || ':' || lpad(cast((sec % 3600) // 60 as varchar), 2, '0') || ':' || lpad(cast(sec % 60 as varchar), 2, '0') as b, cast('0x' || substr(md5('p:' || event_id), 1, 7) as bigint) % 3 as k from ev) "
        "select event_id, case k when 0 then 'How many ' || a || ' are there at ' || b || '?' when 1 then 'At ' || b || ', what is the number of ' || a || '?' else 'Count the ' || a || ' seen at ' || b || '.' end as v from q",
    ),
    "txt_sentence_dropout": (txt_sentence_dropout, f"with a as (select doc_id, text as t from documents) select doc_id, case when substr(md5('drop:' || doc_id), 1, 8) < '{int(2**32 / 3):08x}' then regexp_replace(t, '^[^.]*\\.\\s*', '') else t end as v from a"),
    "txt_group_map": (txt_group_map, "with " + EV + " select case when cls in ('view', 'click') then 'PASSIVE' when cls in ('purchase', 'signup') then 'ACTIVE' else 'OTHER' end as grp, count(*) as n from ev group by 1"),
    "txt_question_family": (txt_question_family, f"with {QS} select case when regexp_matches(q, '(?i)^in\\b|how many|number') then 'count' when regexp_matches(q, '(?i)when|hh:mm:ss') then 'time' when regexp_matches(q, '(?i)select') then 'choice' when regexp_matches(q, '(?i)yes or no|^are|\\bis the\\b') then 'yes_no' else 'other' end as family, count(*) as n from qs group by 1"),
    "txt_prompt_assembly": (txt_prompt_assembly, f"with {QS}, f as (select *, {FORM} as form from qs) select conv_id, turn, concat_ws(chr(10), 'You answer questions about a video.', case form when 'number' then 'Give digits only.' when 'binary' then 'Say yes or no.' end, 'Format: ' || form, q) as prompt from f"),
    "txt_count_note": (txt_count_note, "with " + EV + ", c as (select user_id, hr, cls, count(*) as n from ev group by 1, 2, 3) select user_id, hr, string_agg(n || ' ' || cls, ', ' order by n desc, cls) as note from c group by 1, 2"),
    "txt_route": (txt_route, "select case when contains(lower(trim(c_mktsegment)), 'auto') then 'A' when regexp_matches(c_mktsegment, '^[BF]') then 'B' when c_mktsegment is null then 'none' else 'C' end as route, count(*) as n from customer group by 1"),
    "tm_hhmmss": (
        tm_hhmmss,
        "with a as (select distinct l_extendedprice - 2000 as x from lineitem), b as (select cast(floor(x * 100 + 0.5) as bigint) as x100 from a), c as (select x100, cast(greatest(round_even(x100 / 2, 0), 0) as bigint) as s from b) "
        "select x100, case when s // 3600 < 10 then '0' else '' end || (s // 3600) || ':' || lpad(cast((s // 60) % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as clock from c",
    ),
    "txt_anchor_times": (txt_anchor_times, f"with {CK} select o_orderkey, array_to_string({_SEC.format(l=_MATCH)}, ',') as v from ck"),
    "txt_time_parse": (txt_time_parse, f"with {CK}, p as (select o_orderkey, string_split(t, ', ') as ps from ck) select o_orderkey, case when len(list_filter(ps, lambda x: not regexp_full_match(x, '{X.TIMESTAMP}'))) = 0 then array_to_string(list_sort({_SEC.format(l='ps')}), ',') end as v from p"),
    "tm_loose_parse": (tm_loose_parse, f"with {CK}, p as (select o_orderkey, string_split(t, ', ') as ps from ck) select o_orderkey, case when len(list_filter(ps, lambda x: not regexp_full_match(x, '[0-9]+:[0-9]+:[0-9]+'))) = 0 then array_to_string({_SEC.format(l='ps')}, ',') else '' end as v from p"),
    "tm_millis": (tm_millis, "select o_orderkey, 3723.0 + cast(o_orderkey % 1000 as double) / 1000 as v from orders"),
    "tm_tolerance": (
        tm_tolerance,
        "with a as (select o_orderkey, o_orderkey % 1000 as dur from orders), b as (select *, least(greatest(cast(floor(dur / 5.0) as bigint) + 1, 8), 96) as frames from a) select o_orderkey, round(least(5.0, 1 + dur * 4 / 360), 6) as tol, cast(least(15 * greatest(1, ceil(dur * 3 / 600)), 30) as bigint) as stride, frames, case when frames <= 32 then 768 when frames <= 64 then 560 else 448 end as size from b",
    ),
    "tm_clamp_centre": (tm_clamp_centre, f"with {CK}, p as (select o_orderkey, [least(greatest(x, 3600), 72000) for x in {_SEC.format(l=_MATCH)}] as l from ck) select o_orderkey, array_to_string(l, ',') as clamped, case when len(l) <= 1 then array_to_string(l, ',') else cast(list_sort(l)[(len(l) - 1) // 2 + 1] as varchar) end as mid from p"),
    "tm_linspace": (
        tm_linspace,
        "with a as (select o_orderkey, o_orderkey % 5 as n from orders), b as (select o_orderkey, n, unnest(range(n)) as pos from a) select o_orderkey, pos, round(case when n = 1 then o_orderkey + 6.0 else o_orderkey + 12.0 * pos / (n - 1) end, 6) as x from b",
    ),
    "tm_quadrant": (tm_quadrant, "with a as (select p_partkey % 100 as x, (p_partkey * 37) % 100 as y from part) select case when y * 2 < 100 then 'top' else 'bottom' end || '/' || case when x * 2 < 100 then 'left' else 'right' end as quad, count(*) as n from a group by 1"),
    "tm_gauss": (tm_gauss, "with a as (select o_orderkey, cast(o_orderkey % 50 as double) as t from orders) select o_orderkey, round(exp(-power((t - 10) / 5, 2) / 2) + exp(-power((t - 20) / 5, 2) / 2), 6) as w from a"),
    "tm_cache_key": (tm_cache_key, "select page_id, substr(sha1(concat_ws('|', url, cast(page_id as varchar))), 1, 20) as k from pages"),
}
