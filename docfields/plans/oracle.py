"""Equivalent DuckDB statements for the registered queries.

Each statement is a chain of common table expressions ending in one SELECT. The corpora are rendered again
from the same tables, independently of the Spark code.
"""

from __future__ import annotations

from docfields import rules
from docfields.plans.queries import PRICE_BOUNDS, RUN_ID

_AMOUNT_TYPE = "decimal(28,10)"


def _money(cents: str) -> str:
    return f"((({cents}) // 100)::varchar || '.' || lpad((({cents}) % 100)::varchar, 2, '0'))"


def _money_with_comma(cents: str) -> str:
    return (
        f"(case when ({cents}) // 100 >= 1000 then (({cents}) // 100000)::varchar || ',' || "
        f"lpad(((({cents}) // 100) % 1000)::varchar, 3, '0') || '.' || lpad((({cents}) % 100)::varchar, 2, '0') "
        f"else {_money(cents)} end)"
    )


def _list(items: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(items) + "]"


def _names(names: list[str] | tuple[str, ...]) -> str:
    return _list([f"'{name}'" for name in names])


_INVOICE_TRUTH = {
    "invoice_number": "'INV-' || k",
    "invoice_date": "d::varchar",
    "due_date": "(d + 30)::varchar",
    "subtotal_amount": _money("sub"),
    "tax_amount": f"case when k % 47 <> 0 then {_money('tax')} end",
    "total_amount": _money("sub + tax"),
    "tax_id": "'12-' || (1000000 + k % 9000000)",
    "routing_number": "(100000000 + k)::varchar",
    "bank_account": "(1000000000 + k)::varchar",
}
_ID_TRUTH = {"id_number": "'ID-' || (100000 + k)", "birth_date": "birth::varchar", "expiry_date": "expiry::varchar"}
_TAX_TRUTH = {
    "tax_id": "'98-' || (1000000 + k)",
    "tax_amount": _money("tax"),
    "total_amount": _money("total"),
    "routing_number": "(100000000 + k)::varchar",
}


def _truth(source: str, prefix: str, values: dict[str, str]) -> str:
    return (
        f"select '{prefix}-' || k as doc_id, unnest({_names(list(values))}) as name, "
        f"unnest({_list(list(values.values()))}) as value from {source}"
    )


def _search(pattern: str) -> str:
    # No look-behind here: the text it would exclude is spoiled beforehand.
    text = "text"
    if pattern.startswith("(?<!ub )"):
        pattern = pattern.removeprefix("(?<!ub )")
        text = r"regexp_replace(text, '(ub) (total)', '\1_\2', 'gi')"
    return f"nullif(regexp_extract({text}, '{pattern}', 1, 'i'), '')"


def _field(name: str, pattern: str) -> str:
    value = _search(pattern)
    return f"replace({value}, ',', '')" if name in rules.AMOUNT_FIELDS else value


def _date(value: str) -> str:
    slashes = f"regexp_matches({value}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') and {value} not like '%/0000'"
    return (
        f"coalesce(try_cast(case when regexp_matches({value}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') "
        f"and {value} not like '0000%' then {value} end as date), "
        f"case when {slashes} then coalesce(try_strptime({value}, '%d/%m/%Y'), try_strptime({value}, '%m/%d/%Y')) "
        f"end::date)"
    )


def _amount(value: str) -> str:
    return f"try_cast({value} as {_AMOUNT_TYPE})"


def _amount_text(value: str) -> str:
    return rf"regexp_replace(regexp_replace({value}, '^0+([0-9])', '\1'), '\.$', '')"


def _fraction(value: str) -> str:
    return rf"length(regexp_extract({value}, '\.([0-9]*)', 1))"


def _word(words: tuple[str, ...]) -> str:
    return " or ".join(f"contains(lower(text), '{word}')" for word in words)


_SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_SPACE_CODES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACES = " || ".join(f"chr({code})" for code in _SPACE_CODES)

_DIFFERENCE = f"abs({_amount('subtotal_amount')} + {_amount('tax_amount')} - {_amount('total_amount')})"
_DIGITS = f"greatest({', '.join(_fraction(f) for f in rules.AMOUNT_FIELDS)})"
_CONFIDENCES = _list([str(rules.CONFIDENCE[f]) for f in rules.ALL_FIELDS])
_CHECKED = ("invoice_number", "tax_id", "routing_number", "bank_account", "id_number", "total_amount", "due_date", "expiry_date")
_ERRORS = tuple(f for f in _CHECKED if f != "due_date")


def _format(field: str, pattern: str) -> str:
    return (
        f"case when {field} <> '' and not regexp_matches({field}, '{pattern}') "
        f"then 'Regex validation failed for value ''' || {field} || '''' end as msg_{field}"
    )


_MEAN = "coalesce(sum(case when word <> '' then conf::decimal(20,16) end)::double / nullif(count(nullif(word, '')), 0) / 100, 0.0)"

def _wide(source: str, true_type: str) -> str:
    return (
        f"select doc_id, {true_type} as doc_type_truth, "
        f"case when {_word(rules.INVOICE_WORDS)} then 'invoice' "
        f"when {_word(rules.ID_CARD_WORDS)} or regexp_matches(text, '{rules.MRZ_PATTERN}') then 'id_card' "
        f"when {_word(rules.TAX_FORM_WORDS)} then 'tax_form' else 'unknown' end as doc_type, "
        + ", ".join(f"{_field(name, pattern)} as {name}" for name, pattern, _ in rules.FIELD_RULES)
        + f", regexp_extract_all(text, '{rules.MRZ_PATTERN}', 1)[1] as mrz_line1"
        + f", regexp_extract_all(text, '{rules.MRZ_PATTERN}', 1)[2] as mrz_line2 from {source}"
    )


def _checks(source: str) -> str:
    return (
        f"select *, '{RUN_ID}' || '|' || doc_id as rid, "
        + ", ".join(_format(field, pattern) for field, pattern in rules.FORMAT_RULES)
        + f", {_DIFFERENCE} as difference, "
        + f"case when {_DIFFERENCE} > {rules.TOTAL_TOLERANCE} then "
        + f"'subtotal (' || {_amount_text('subtotal_amount')} || ') + tax (' || {_amount_text('tax_amount')} || "
        + f"') != total (' || {_amount_text('total_amount')} || '); diff=' || substr({_DIFFERENCE}::varchar, 1, "
        + f"strpos({_DIFFERENCE}::varchar, '.') + case when {_DIGITS} > 0 then {_DIGITS} else -1 end) "
        + "end as msg_total_amount, "
        + f"case when {_date('invoice_date')} > {_date('due_date')} "
        + "then 'Due date earlier than invoice date' end as msg_due_date, "
        + f"case when {_date('expiry_date')} < {_date('birth_date')} "
        + f"then 'Expiry date earlier than birth date' end as msg_expiry_date from {source}"
    )


def _field_rows(source: str) -> str:
    flags = [f"msg_{f} is null" if f in _ERRORS else "true" for f in rules.ALL_FIELDS]
    return (
        "select sha256(rid) as request_id, doc_id, doc_type, field_name, value, confidence, valid from ("
        f"select rid, doc_id, doc_type, unnest({_names(rules.ALL_FIELDS)}) as field_name, "
        f"unnest({_list(rules.ALL_FIELDS)}) as value, unnest({_CONFIDENCES})::double as confidence, "
        f"unnest({_list(flags)}) as valid from {source}) where value is not null"
    )


# Name -> (names it reads, query text)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "inv": (
        (),
        "select o_orderkey as k, o_orderdate::date as d, sub, (sub * 8 + 50) // 100 as tax from orders join "
        "(select l_orderkey, sum(round(l_extendedprice * 100)::bigint)::bigint as sub from lineitem group by 1) "
        "on o_orderkey = l_orderkey",
    ),
    "card": (
        (),
        "select c_custkey as k, c_name, date '1960-01-01' + ((c_custkey * 37) % 14000)::integer as birth, "
        "date '2026-01-01' + ((c_custkey * 53) % 3650)::integer as expiry from customer",
    ),
    "form": (
        (),
        "select k, total, (total * 8 + 50) // 100 as tax from "
        "(select s_suppkey as k, abs(round(s_acctbal * 100)::bigint) as total from supplier)",
    ),
    "invoice_corpus": (
        ("inv",),
        "select 'invoice-' || k as doc_id, 'invoice' as doc_type, concat_ws(chr(10), "
        "'Invoice Number: ' || case when k % 31 = 0 then '' when k % 11 = 0 then '-' || k else 'INV-' || k end, "
        "'Invoice Date: ' || case when k % 37 = 0 then strftime(d, '%d/%m/%y') "
        "when k % 7 = 0 then strftime(d, '%d/%m/%Y') else d::varchar end, "
        "'Due Date: ' || case when k % 13 = 0 then (d - 5)::varchar else (d + 30)::varchar end, "
        "case when k % 29 = 0 then 'Sub-Total: $' when k % 19 = 0 then 'Sub Total: $' else 'Subtotal: $' end || "
        f"{_money('sub')}, "
        f"case when k % 23 <> 0 and k % 47 <> 0 then 'Tax: $' || {_money('tax')} end, "
        f"'Total: $' || case when k % 43 = 0 then {_money_with_comma('shown')} else {_money('shown')} end, "
        "case when k % 47 = 0 then 'Tax ID ' else 'Tax ID: ' end || '12-' || (1000000 + k % 9000000), "
        "'Routing Number: ' || (100000000 + k), 'Account Number: ' || (1000000000 + k)) as text "
        "from (select *, sub + tax + case when k % 17 = 0 then 100 else 0 end "
        "+ case when k % 41 = 0 then 2 else 0 end as shown from inv)",
    ),
    "card_corpus": (
        ("card",),
        "select 'id-' || k as doc_id, 'id_card' as doc_type, concat_ws(chr(10), "
        "case when k % 7 = 0 then null when k % 5 = 0 then 'PASSPORT' else 'IDENTIFICATION CARD' end, "
        "'ID Number: ID-' || (100000 + k), 'Date of Birth: ' || birth::varchar, "
        "'Expiry: ' || case when k % 17 = 0 then (birth - 30)::varchar else expiry::varchar end, "
        "rpad('P<EXA' || replace(upper(c_name), '#', '<'), 30, '<'), "
        "rpad('L' || lpad(k::varchar, 9, '0'), case k % 3 when 0 then 29 when 1 then 30 else 44 end, '<')) as text "
        "from card",
    ),
    "form_corpus": (
        ("form",),
        "select 'tax-' || k as doc_id, 'tax_form' as doc_type, concat_ws(chr(10), 'Form 1040', "
        f"'Tax ID: 98-' || (1000000 + k), 'Tax Amount: $' || {_money('tax')}, 'Total: $' || {_money('total')}, "
        "'Routing No.: ' || (100000000 + k)) as text from form",
    ),
    "corpus": (
        ("invoice_corpus", "card_corpus", "form_corpus"),
        "select * from invoice_corpus union all select * from card_corpus union all select * from form_corpus "
        "union all select 'doc-' || doc_id, 'unknown', text from documents",
    ),
    "truth": (
        ("inv", "card", "form"),
        "select * from ("
        + " union all ".join(
            (
                _truth("inv", "invoice", _INVOICE_TRUTH),
                _truth("card", "id", _ID_TRUTH),
                _truth("form", "tax", _TAX_TRUTH),
            )
        )
        + ") where value is not null",
    ),
    "wide": (("corpus",), _wide("corpus", "doc_type")),
    "checked": (("wide",), _checks("wide")),
    "preds": (
        ("wide",),
        f"select * from (select doc_id, unnest({_names(rules.ALL_FIELDS)}) as name, "
        f"unnest({_list(rules.ALL_FIELDS)}) as value, unnest({_CONFIDENCES})::double as confidence from wide) "
        "where value is not null",
    ),
    "msgs": (
        ("checked",),
        f"select * from (select doc_id, unnest({_names(_CHECKED)}) as field, "
        f"unnest({_list([f'msg_{f}' for f in _CHECKED])}) as message, "
        f"unnest({_names(['warning' if f == 'due_date' else 'error' for f in _CHECKED])}) as level from checked) "
        "where message is not null",
    ),
    "frows": (("checked",), _field_rows("checked")),
    # The same rules over the text that the words give: pages of twelve words, some of them blank.
    "wide_w": (("dtexts",), _wide("(select doc_id, full_text as text from dtexts)", "null")),
    "checked_w": (("wide_w",), _checks("wide_w")),
    "found": (
        ("checked_w",),
        "select doc_id, rid, list_filter(["
        + ", ".join(f"{{'f': '{f}', 'm': msg_{f}}}" for f in _ERRORS)
        + "], lambda x: x.m is not null) as errs, "
        "list_filter([{'f': 'due_date', 'm': msg_due_date}], lambda x: x.m is not null) as warns from checked_w",
    ),
    "frows_w": (("checked_w",), _field_rows("checked_w")),
    "words": (
        ("tokens_",),
        "select doc_id, (i // 12 + i // 48 + bp)::integer as page_index, 'page' || (i // 12 + i // 48 + bp) as page_name, "
        "case when bp = 1 then 0 else (i % 12) * 2 + sub end::integer as pos, shown as text, "
        f"trim(shown, {_SPACES}) as word, (50 + (i * 7) % 50)::double as conf, ((i % 12) * 40)::integer as left_, "
        "((i // 12) * 20)::integer as top_, (8 * length(shown))::integer as width_, 16 as height_ from ("
        "select doc_id, i, 0 as bp, 0 as sub, case when i % 5 = 0 then '  ' || token || chr(9) else token end as shown from tokens_ "
        "union all select doc_id, i, 0, 1, ' ' from tokens_ where i % 9 = 0 "
        "union all select doc_id, i, 1, 0, ' ' from tokens_ where i % 48 = 47)",
    ),
    "tokens_": (
        ("corpus",),
        "select doc_id, unnest(w) as token, generate_subscripts(w, 1) - 1 as i from ("
        r"select doc_id, string_split_regex(text, '[ \t\r\n]+') as w from corpus)",
    ),
    "toks": (("words",), "select * from words where word <> ''"),
    "ptexts": (
        ("words",),
        "select doc_id, page_index, page_name, "
        "coalesce(string_agg(nullif(word, ''), ' ' order by pos), '') as page_text, "
        f"count(nullif(word, '')) as token_count, {_MEAN} as avg_confidence from words group by all",
    ),
    "dtexts": (
        ("ptexts",),
        "select doc_id, string_agg(page_text, chr(10) order by page_index) as full_text from ptexts group by 1",
    ),
    "pairs": (
        ("truth", "preds"),
        "select * from (select doc_id, name, gt, pred, case when gt <> '' and gt = pred then 'tp' "
        "when gt <> '' and pred <> '' then 'wrong' when gt <> '' then 'missed' when pred <> '' then 'spurious' end "
        "as status from (select coalesce(t.doc_id, p.doc_id) as doc_id, coalesce(t.name, p.name) as name, "
        f"replace(lower(trim(coalesce(t.value, ''), {_SPACES})), ',', '') as gt, "
        f"replace(lower(trim(coalesce(p.value, ''), {_SPACES})), ',', '') as pred "
        "from truth t full join preds p on t.doc_id = p.doc_id and t.name = p.name)) where status is not null",
    ),
    "counts": (
        ("pairs",),
        "select name, count(*) filter (status = 'tp') as tp, "
        "count(*) filter (status in ('wrong', 'spurious')) as fp, "
        "count(*) filter (status in ('wrong', 'missed')) as fn from pairs group by name",
    ),
    "metrics": (
        ("counts",),
        "select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end "
        "as f1 from (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, "
        "case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall from counts)",
    ),
    "ranking": (
        ("frows",),
        "select field_name as field, count(*) as failures from frows where not valid group by 1 "
        "order by failures desc, field limit 20",
    ),
    "filenames": (
        (),
        "select o_orderkey as upload, case when o_orderkey % 35 = 0 then null when o_orderkey % 21 = 0 then '' "
        "else 'order-' || o_orderkey || ['.pdf', '.PDF', '.Pdf', '.png', '.pdf.txt'][o_orderkey % 5 + 1] end as name "
        "from orders",
    ),
}


def _statement(final: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for inner in _CTES[name][0]:
            add(inner)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    chain = ",\n".join(f"{name} as materialized ({_CTES[name][1]})" for name in order)
    return f"with {chain}\n{final}" if order else final


def _round(value: str) -> str:
    return f"printf('%.3f', {value})::double"


def _histogram(column: str, table: str, bounds: tuple[int, ...]) -> str:
    labels = _names([str(b) for b in bounds] + ["+Inf"])
    counts = _list([f"count(*) filter ({column} <= {b})" for b in bounds] + [f"count({column})"])
    return (
        f"select unnest({labels}) as le, unnest(b) as bucket, observations, total from (select {counts} as b, "
        f"count({column}) as observations, sum({column}::decimal(18,2))::double as total from {table})"
    )


_COUNT_ERRORS = " + ".join(f"(msg_{f} is not null)::integer" for f in _ERRORS)
_WARNED = "(msg_due_date is not null)::integer"
_REPORT = (
    f"select name as field, tp, fp, fn, {_round('precision')} as precision, {_round('recall')} as recall, "
    f"{_round('f1')} as f1 from metrics"
)
_ROWS = "select request_id, doc_type, field_name, value, confidence, valid from frows"


def all_statements() -> dict[str, str]:
    made: dict[str, str] = {
        "corpus_invoices": _statement("select * from invoice_corpus", "invoice_corpus"),
        "corpus_id_cards": _statement("select * from card_corpus", "card_corpus"),
        "corpus_all": _statement("select * from corpus", "corpus"),
        "corpus_truth": _statement("select * from truth", "truth"),
        "words_clean": _statement(
            "select doc_id, page_index, pos, word as text, conf / 100 as confidence from toks", "toks"
        ),
        "words_boxes": _statement(
            "select doc_id, pos, left_ as x0, top_ as y0, left_ + width_ as x1, top_ + height_ as y1 from toks",
            "toks",
        ),
        "page_renumber": _statement(
            "select doc_id, page_index, (row_number() over (partition by doc_id order by page_index))::integer as page_num "
            "from (select distinct doc_id, page_index from words)",
            "words",
        ),
        "page_cap": _statement("select doc_id, page_index, pos from words where page_index < 2", "words"),
        "page_text": _statement("select doc_id, page_index, page_text from ptexts", "ptexts"),
        "document_text": _statement("select * from dtexts", "dtexts"),
        "page_stats": _statement("select doc_id, page_index, token_count, avg_confidence from ptexts", "ptexts"),
        "document_stats": _statement(
            "select doc_id, count(distinct page_index) as pages, count(nullif(word, '')) as token_count, "
            f"{_MEAN} as avg_confidence from words group by 1",
            "words",
        ),
        "document_fingerprint": _statement(
            "select doc_id, count(*) as page_count, sha256(string_agg(page_text, '' order by page_name)) as checksum "
            "from ptexts group by 1",
            "ptexts",
        ),
        "amounts_clean": _statement(f"select doc_id, {', '.join(rules.AMOUNT_FIELDS)} from wide", "wide"),
        "extract_mrz": _statement("select doc_id, mrz_line1, mrz_line2 from wide", "wide"),
        "doc_type": _statement("select doc_id, doc_type from wide", "wide"),
        "predictions_long": _statement("select *, 'regex' as source from preds", "preds"),
        "field_map": _statement("select * from preds", "preds"),
        "normalize_amounts": _statement(
            "select doc_id, " + ", ".join(f"try_cast({f} as double) as {f}" for f in rules.AMOUNT_FIELDS) + " from wide",
            "wide",
        ),
        "normalize_dates": _statement(
            "select doc_id, "
            + ", ".join(
                f"{_date(f)}::varchar as {f}" for f in ("invoice_date", "due_date", "expiry_date", "birth_date")
            )
            + " from wide",
            "wide",
        ),
        "check_totals": _statement(
            "select doc_id, difference::double as difference, msg_total_amount as message from checked", "checked"
        ),
        # Subtotal and tax are 0 or 1 and the total is larger than both, so it always differs.
        "huge_amounts": "select 'huge-' || o_orderkey as doc_id, "
        "repeat('9', (o_orderkey % 40)::integer) || round(o_totalprice * 100)::bigint as digits, "
        "true as differs from orders",
        "check_due_date": _statement("select doc_id, msg_due_date as message from checked", "checked"),
        "check_expiry": _statement("select doc_id, msg_expiry_date as message from checked", "checked"),
        "messages": _statement("select * from msgs", "msgs"),
        "error_warning_split": _statement(
            f"select doc_id, {_COUNT_ERRORS} as n_errors, concat_ws(',', "
            + ", ".join(f"case when msg_{f} is not null then '{f}' end" for f in _ERRORS)
            + f") as error_fields, {_WARNED} as n_warnings, "
            + "case when msg_due_date is not null then 'due_date' else '' end as warning_fields from checked",
            "checked",
        ),
        "is_valid": _statement(f"select doc_id, ({_COUNT_ERRORS}) = 0 as is_valid from checked", "checked"),
        "field_valid": _statement("select request_id, field_name, valid from frows", "frows"),
        "response_nested": _statement(
            "select sha256(rid) as request_id, doc_type, "
            + " + ".join(f"({f} is not null)::integer" for f in rules.ALL_FIELDS)
            + f" as n_fields, {_COUNT_ERRORS} as n_errors, {_WARNED} as n_warnings from checked",
            "checked",
        ),
        # Every page has a record; those without words give one row without a token.
        "ocr_json_roundtrip": _statement(
            "select p.doc_id, p.page_num, p.page_text as full_text, p.token_count, p.avg_confidence, t.n, t.text, t.confidence, "
            "t.x0, t.y0, t.x1, t.y1 from (select *, (row_number() over (partition by doc_id order by page_index))::integer "
            "as page_num from ptexts) p left join (select doc_id, page_index, "
            "(row_number() over (partition by doc_id, page_index order by pos) - 1)::integer as n, word as text, "
            "conf / 100 as confidence, left_ as x0, top_ as y0, left_ + width_ as x1, top_ + height_ as y1 from toks) t "
            "on p.doc_id = t.doc_id and p.page_index = t.page_index",
            "toks",
            "ptexts",
        ),
        "words_complete": _statement(
            "select (select count(*) from tokens_ where token <> '') as tokens, count(*) as words, "
            "sum(length(word))::bigint as characters from toks",
            "toks",
        ),
        "response_from_words": _statement(
            "select sha256(e.rid) as request_id, a.avg_confidence as ocr_avg_confidence, list, place, x.f as field, x.m as message, "
            "case list when 'errors' then 'error' when 'warnings' then 'warning' end as level from found e "
            "join (select doc_id, " + _MEAN + " as avg_confidence from words group by 1) a on a.doc_id = e.doc_id "
            "left join (select doc_id, 'errors' as list, unnest(range(len(errs)))::integer as place, unnest(errs) as x from found "
            "union all select doc_id, 'warnings', unnest(range(len(warns)))::integer, unnest(warns) from found) l on l.doc_id = e.doc_id",
            "found",
            "words",
        ),
        "words_stored": _statement(
            "select form, page_index, count(*) as words, sum(pos)::bigint as positions, sum(length(shown))::bigint as characters, "
            "sum(conf) as confidence, sum(left_)::bigint as left_sum, max(height_) as height "
            "from (select text as shown, * from words), (select unnest(['parquet', 'json']) as form) group by 1, 2",
            "words",
        ),
        "documents_stored": _statement("select doc_id, sha256(text) as digest, true as same from corpus", "corpus"),
        "stream_docs_by_type": _statement("select doc_type, count(*) as documents from wide group by 1", "wide"),
        "stream_errors_by_field": _statement(
            "select field, count(*) as errors from msgs where level = 'error' group by 1", "msgs"
        ),
        "stream_and_batch": _statement(
            "select field_name, valid, 3 * count(*) as stored, 3 * count(distinct request_id) as requests, "
            "3 * count(*) as stamped from frows group by 1, 2",
            "frows",
        ),
        "admitted": _statement("select * from filenames where lower(name) like '%.pdf'", "filenames"),
        "rejected": _statement(
            "select * from filenames where not coalesce(lower(name) like '%.pdf', false)", "filenames"
        ),
        "field_coverage": _statement(
            f"select name, type, coalesce(n, 0) as extracted from (select "
            f"unnest({_names([c[0] for c in rules.FIELD_CATALOG])}) as name, "
            f"unnest({_names([c[1] for c in rules.FIELD_CATALOG])}) as type) left join "
            "(select field_name, count(*) as n from frows group by 1 union all "
            "select 'document_type', count(distinct request_id) from frows) on name = field_name",
            "frows",
        ),
        "top_failures": _statement("select * from ranking", "ranking"),
        "recurrent_failures": _statement(
            "select field_name, count(*) as failures from frows where not valid group by 1 "
            "order by failures desc, field_name limit 10",
            "frows",
        ),
        "low_accuracy_values": _statement(
            "select value, count(*) as total, avg(valid::integer) as accuracy from frows "
            "where field_name = 'expiry_date' group by 1 having avg(valid::integer) < 0.9",
            "frows",
        ),
        "responses_with_failures": _statement(
            "select sha256(rid) as request_id, (select string_agg(field || ':' || failures, ';' "
            "order by failures desc, field) from ranking) as ranking from checked",
            "ranking",
            "checked",
        ),
        "docs_by_type": _statement("select doc_type, count(*) as documents from wide group by 1", "wide"),
        "errors_by_field": _statement(
            "select field, count(*) as errors from msgs where level = 'error' group by 1", "msgs"
        ),
        "histogram_event_value": _histogram("value", "events", rules.LATENCY_BOUNDS_MS),
        "responses_quarantined": _statement(
            "select count(*) as responses, count(*) filter (sha256(rid) like '0%') as quarantined, "
            "count(*) + count(*) filter (sha256(rid) like '0%') as records, count(*) as good_rows from checked",
            "checked",
        ),
        "stream_histogram_event_value": _histogram("value", "events", rules.LATENCY_BOUNDS_MS),
        "histogram_order_price": _histogram("o_totalprice", "orders", PRICE_BOUNDS),
        "eval_normalized": _statement(
            f"select doc_id, name, replace(lower(trim(value, {_SPACES})), ',', '') as compared from preds", "preds"
        ),
        "eval_pairs": _statement("select * from pairs", "pairs"),
        "eval_counts": _statement("select * from counts", "counts"),
        "eval_field_metrics": _statement("select * from metrics", "metrics"),
        "eval_micro": _statement(
            "select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) "
            "end as f1 from (select tp, fp, fn, tp / (tp + fp) as precision, tp / (tp + fn) as recall from "
            "(select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from counts))",
            "counts",
        ),
        "eval_sample_count": _statement("select count(*) as n_samples from corpus", "corpus"),
        "eval_records": _statement(
            "select c.doc_id, doc_type as doc_type_predicted, doc_type_truth, "
            f"{_COUNT_ERRORS} as n_errors, {_WARNED} as n_warnings, name, gt, pred, status "
            "from checked c left join pairs p on c.doc_id = p.doc_id",
            "checked",
            "pairs",
        ),
        "eval_report": _statement(_REPORT, "metrics"),
        "stream_failures": _statement("select * from ranking", "ranking"),
    }
    for times, name in ((3, "maintained_top_failures"), (2, "stream_failures_history")):
        made[name] = _statement(
            f"select field_name as field, {times} * count(*) as failures from frows where not valid group by 1 "
            "order by failures desc, field limit 20",
            "frows",
        )
    for name in ("response_flat", "response_json_roundtrip", "persisted_extractions", "stream_extract", "stream_redelivered", "published_rerun",
                 "published_compacted"):
        made[name] = _statement(_ROWS, "frows")
    made["extract_from_words"] = _statement(f"{_ROWS}_w", "frows_w")
    made["eval_pairs_local"] = made["eval_pairs"]
    # Repeated names: the entry with the largest seq wins (a dict filled in order).
    repeated_truth = (
        "(select doc_id, name, arg_max(value, seq) as value from (select doc_id, name, value, 0 as seq from truth "
        "union all select doc_id, name, value || '-stale', -1 from truth) group by 1, 2)"
    )
    repeated_preds = (
        "(select doc_id, name, arg_max(value, seq) as value from (select doc_id, name, value, 0 as seq from preds "
        "union all select doc_id, name, value || '-old', -1 from preds "
        "union all select doc_id, name, 'planted', 1 from preds where name = 'invoice_number') group by 1, 2)"
    )
    made["eval_pairs_repeated"] = _statement(
        _CTES["pairs"][1].replace("from truth t full join preds p", f"from {repeated_truth} t full join {repeated_preds} p"),
        "truth", "preds",
    )
    made["eval_written"] = made["eval_report"]
    made["eval_written_samples"] = made["eval_records"]
    made["eval_written_micro"] = _statement(
        f"select n_samples, tp, fp, fn, {_round('precision')} as precision, {_round('recall')} as recall, "
        f"{_round('2 * precision * recall / (precision + recall)')} as f1 from (select *, tp / (tp + fp) as precision, "
        "tp / (tp + fn) as recall from (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from counts)), "
        "(select count(*) as n_samples from corpus)",
        "counts",
    )
    for field in rules.RULE_FIELDS:
        made[f"extract_{field}"] = _statement(f"select doc_id, {field} from wide", "wide")
    for field, _ in rules.FORMAT_RULES:
        made[f"check_format_{field}"] = _statement(
            f"select doc_id, {field} as value, msg_{field} as message from checked", "checked"
        )
    return made
