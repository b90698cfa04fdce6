"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

import math

from lotwise.llm import conversation_repair as repair
from lotwise.llm import fill_in_middle as fim
from lotwise.llm import quality_rules as rules
from lotwise.llm import simhash
from lotwise.llm import url_filter as urls

SYMBOLS = "[#*$%&|<>]"


def quality_rules_sql() -> str:
    """Features by unnesting words and runs; the fit as a recursive table of one row per start and round."""
    names = list(rules.RULES)
    stops = ", ".join(f"'{w}'" for w in rules.STOPS)
    votes = ",\n      ".join(f"case when {bad} then 1 when {good} then 0 end as {n}" for n, (bad, good) in rules.RULES.items())
    of_bad = "ln(prior)" + "".join(f" + case {n} when 1 then ln(s[{k}]) when 0 then ln(1 - s[{k}]) else 0 end" for k, n in enumerate(names, 1))
    of_good = "ln(1 - prior)" + "".join(f" + case {n} when 1 then ln(f[{k}]) when 0 then ln(1 - f[{k}]) else 0 end" for k, n in enumerate(names, 1))
    (share1, share0), (s1, s0), (f1, f0) = rules.SHARE_PRIOR, rules.SENSITIVITY_PRIOR, rules.ALARM_PRIOR
    s = ",\n        ".join(f"(sum(case when {n} = 1 then q else 0 end) + {s1}) / (sum(case when {n} is not null then q else 0 end) + {s1 + s0})" for n in names)
    f = ",\n        ".join(f"(sum(case when {n} = 1 then n - q else 0 end) + {f1}) / (sum(case when {n} is not null then n - q else 0 end) + {f1 + f0})" for n in names)
    starts = " union all ".join(
        f"select {k}, 0, cast({p} as double), list_transform(range({len(names)}), lambda x: cast({a} as double)), list_transform(range({len(names)}), lambda x: cast({b} as double))"
        for k, (p, a, b) in enumerate(rules.STARTS)
    )
    base = f"(n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words)"
    return f"""with recursive t as (
      select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
    runs as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from t where len(w) >= 5)),
    again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from runs) where n > 1),
    covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) group by 1),
    features as (select t.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
      length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
      coalesce(c.n, 0) as n_repeat_words, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_upper,
      length(text) - length(replace(text, '!', '')) as n_exclaims, len(list_distinct(w)) as n_distinct,
      len(list_filter(w, lambda x: regexp_matches(x, '{rules.PLAIN}'))) as n_plain,
      len(list_filter(w, lambda x: x in ({stops}))) as n_stops,
      len(list_filter(w, lambda x: regexp_matches(x, '{rules.MARKED}'))) as n_marked,
      len(list_filter(w, lambda x: regexp_matches(x, '{rules.DIGIT}'))) as n_digits
      from t left join covered c on c.doc_id = t.doc_id),
    voted as materialized (select *, {base} as base_failed,
      {votes} from features),
    patterns as materialized (select {", ".join(names)}, count(*) as n from voted where not base_failed group by all),
    em(start, k, prior, s, f) as ({starts} union all
      select start, any_value(k) + 1, (sum(q) + {share1}) / (sum(n) + {share1 + share0}),
        [{s}],
        [{f}]
      from (select p.*, start, k, n / (1 + exp(least(700, ({of_good}) - ({of_bad})))) as q from em, patterns p where k < 300) group by start),
    ends as (select * from em where k = 300),
    densities as (select start, sum(n * (greatest(x, y) + ln(exp(x - greatest(x, y)) + exp(y - greatest(x, y))))) as d
      from (select start, n, {of_bad} as x, {of_good} as y from ends, patterns) group by start),
    best as (select e.* from ends e join densities using (start)
      order by list_sum(s) > list_sum(f) desc, d + {share1} * ln(prior) + {share0} * ln(1 - prior)
        + list_sum(list_transform(s, lambda x: {s1} * ln(x) + {s0} * ln(1 - x))) + list_sum(list_transform(f, lambda x: {f1} * ln(x) + {f0} * ln(1 - x))) desc limit 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and 1 - 1 / (1 + exp(({of_good}) - ({of_bad}))) >= {rules.KEEP} as kept from voted left join best on true"""


def warc_sql() -> str:
    """Base32 of a SHA-1 from its hexadecimal digits, five digits to four characters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base32 = f"array_to_string(list_transform(range(32), lambda k: substr('{alphabet}', 1 + (cast(concat('0x', substr(h, cast(1 + 5 * (k // 4) as int), 5)) as bigint) >> cast(15 - 5 * (k % 4) as int)) % 32, 1)), '')"
    return f"""select page_id, payload_bytes, payload_digest, case when place = 1 then 'response' else 'revisit' end as record_type,
      case when place > 1 then first_id end as refers_to
    from (select page_id, n as payload_bytes, {base32} as payload_digest, min(page_id) over (partition by h) as first_id,
        row_number() over (partition by h order by page_id nulls last, url) as place
      from (select page_id, url, sha1(coalesce(html, '')) as h, strlen(coalesce(html, '')) as n from pages))"""


def chat_sql() -> str:
    """Every escape has six characters, so the length of the formatted text needs only the places of what is escaped."""
    escaped = "length(regexp_replace({0}, '<\\||\\[|</|<\\z|\\|>', 'xxxxxx', 'g'))"
    return f"""select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256, sum(7 + {escaped.format('role')} + 2 + {escaped.format('text')} + 8)::bigint as formatted_chars
    from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]') group by conv_id"""


def url_filter_sql() -> str:
    """Rounds of both ranks as a recursive table of one row per host and round."""
    order = sorted(urls.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = {r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')" for r in order}
    rule = "case " + " ".join(f"when {fits[r]} then '{r[1]}{r[2]}'" for r in order) + " end"
    verdict = "case " + " ".join(f"when {fits[r]} then '{r[0]}'" for r in order) + " end"
    d = urls.DAMPING
    rounds = math.ceil(math.log(urls.TOLERANCE) / math.log(d))
    low = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"
    link = urls.LINK.replace("'", "''")
    return f"""with recursive placed as (select page_id, coalesce(html, '') as html,
      {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    judged as (select page_id, host, path, {rule} as rule, {verdict} as known from placed),
    edges as materialized (select src, dst, count(*) as links
      from (select host as src, {low("unnest(regexp_extract_all(html, '" + link + "', 1))")} as dst from placed)
      where src <> '' and src <> dst group by 1, 2),
    hosts as (select host, sum(a) as a, sum(b) as b
      from (select host, count(*) filter (known = 'allow') as a, count(*) filter (known = 'block') as b from judged group by 1 union all select dst, 0, 0 from edges) group by 1),
    sums as (select greatest(sum(a), 1) as a, greatest(sum(b), 1) as b, greatest(count(*), 1) as n from hosts),
    nodes as materialized (select host, hosts.a / sums.a as trusted, hosts.b / sums.b as blocked from hosts, sums),
    flows as materialized (
      select src as origin, dst as host, links / sum(links) over (partition by src) as ahead, 0.0::double as reverse from edges
      union all select dst, src, 0.0, links / sum(links) over (partition by dst) from edges union all select host, host, 0.0, 0.0 from nodes),
    ranks(k, host, trust, distrust) as (select 0, host, {1 - d} * trusted, {1 - d} * blocked from nodes union all
      select any_value(k) + 1, n.host, {1 - d} * any_value(n.trusted) + {d} * sum(trust * ahead), {1 - d} * any_value(n.blocked) + {d} * sum(distrust * reverse)
      from ranks r join flows f on f.origin = r.host join nodes n on n.host = f.host where k < {rounds} group by n.host)
    select page_id, j.host, path, rule,
      coalesce(known, case when distrust > trust and distrust > {urls.THRESHOLD} / n * {1 - d} and j.host <> '' then 'block' else 'allow' end) as verdict
    from judged j join ranks r on r.host = j.host and k = {rounds}, sums"""


def fill_in_middle_sql() -> str:
    """Lines by an expression, cuts by the digest's groups of eight digits, and the text rebuilt by taking markers out of the output."""
    h = lambda k: f"cast(concat('0x', substr(h, {8 * k + 1}, 8)) as bigint)"
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    return f"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u, sha256(concat('{fim.SEED}:', doc_id)) as h from documents),
    drawn as (select *, len(u) as n, least({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) as a, greatest({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1)) as b,
      case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or {h(2)} % 100 >= {fim.FIM_PERCENT} then 'plain' when {h(3)} % 100 < {fim.SPM_PERCENT} then 'spm' else 'psm' end as form from t),
    parts as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from drawn),
    made as (select *, case form when 'plain' then text when 'psm' then concat('{p}', prefix, '{s}', suffix, '{m}', middle) else concat('{s}', suffix, '{p}', prefix, '{m}', middle) end as output from parts)
    select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars, sha256(output) as output_sha256,
      sha256(case form when 'plain' then output when 'psm' then concat(substr(split_part(output, '{s}', 1), 4), split_part(output, '{m}', 2), split_part(split_part(output, '{s}', 2), '{m}', 1))
        else concat(split_part(split_part(output, '{p}', 2), '{m}', 1), split_part(output, '{m}', 2), substr(split_part(output, '{p}', 1), 4)) end) as restored_sha256 from made"""


def conversation_repair_sql() -> str:
    """Turn after turn, the least (cost, audit) of each state of the automaton, with what it has repaired to."""
    table = "list_transform(range(256), lambda n: list_reduce(range(8), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, n))"
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda r, b: xor(r >> 8, t[1 + (xor(r, b) & 255)]), 4294967295::bigint), 4294967295)"
    steps = ", ".join(f"({i}, '{c}', {j})" for (i, c), j in repair.STEP.items())
    return f"""with recursive crc as materialized (select {table} as t),
    keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as k from conversations),
    coded as (select conv_id, turn, role, text, {crc} % 20 as c from keyed, crc),
    damaged as (select conv_id, turn, case when c = 4 then 'user' else role end as role, case c when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
      unnest(range(case when c = 3 then 2 else 1 end)) as copy from coded where c <> 0),
    placed as (select *, row_number() over (partition by conv_id, role, text order by n) as seen
      from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged)),
    faulty as (select *, substr(role, 1, 1) as i, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when seen > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' end as fault from placed),
    turns as materialized (select *, concat(i, '') as own, case when fault = 'truncated' then {repair.TRUNCATED} else 0 end as extra, fault in ('blank', 'duplicate') is true as must_go,
      lag(i) over (partition by conv_id order by n) as before from faulty),
    step(i, c, j) as (values {steps}),
    one(i, j, lines) as (select distinct on (s.i) s.i, s.j, [case s.c when 'a' then 'assistant:' else 'user:' end] from step s where s.c <> 's'),
    closure as materialized (select unnest(range(4)) as i, unnest(range(4)) as j, []::varchar[] as lines
      union all select * from one union all select a.i, b.j, list_concat(a.lines, b.lines) from one a join one b on b.i = a.j where b.j <> a.i),
    ends as (select conv_id, max(n) as n_turns from turns group by 1),
    parsed(conv_id, n, state, best) as (
      select conv_id, 0::bigint, 0::bigint, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} from ends
      union all
      select p.conv_id, p.n + 1, e.j, min({{'cost': p.best.cost + 5 * len(c.lines) + e.cost, 'audit': concat(p.best.audit, repeat('I', len(c.lines)), e.edit), 'lines': list_concat(p.best.lines, c.lines, e.lines)}})
      from parsed p join closure c on c.i = p.state join (
        select t.conv_id, t.n, s.i, s.i as j, 2 as cost, 'D' as edit, []::varchar[] as lines from turns t, (select unnest(range(4)) as i) s
        union all select t.conv_id, t.n, s.i, s.j, t.extra, 'K', [concat(t.role, ':', t.text)] from turns t join step s on s.c = t.own where not must_go
        union all select t.conv_id, t.n, s.i, s.j, t.extra + 1, 'R', [concat(case s.c when 'a' then 'assistant' else 'user' end, ':', t.text)] from turns t, step s where s.c <> 's' and not must_go
      ) e on e.conv_id is not distinct from p.conv_id and e.n = p.n + 1 and e.i = c.j group by p.conv_id, p.n + 1, e.j),
    chosen as (select p.conv_id, min({{'cost': p.best.cost + 5 * len(c.lines), 'audit': concat(p.best.audit, repeat('I', len(c.lines))), 'lines': list_concat(p.best.lines, c.lines)}}) as best
      from parsed p join ends e on e.conv_id is not distinct from p.conv_id and e.n_turns = p.n join closure c on c.i = p.state and c.j in (0, 3) group by 1),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
      count(*) filter (fault = 'truncated') as truncated, count(*) filter (n > 1 and concat(before, i) not in ('su', 'ua', 'au')) as illegal from turns group by 1)
    select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
      coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) a left join counts c on c.conv_id is not distinct from a.conv_id left join chosen b on b.conv_id is not distinct from a.conv_id"""


def simhash_sql() -> str:
    """Runs of words hashed by wrapping arithmetic, votes as one sum per bit, and pairs within the radius by comparing all."""
    mult, plus, size = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, 1 << 64

    def wrap(x: str) -> str:
        return f"(({x}) % {size}::uhugeint)"

    def number(half: int) -> str:
        out = "0::uhugeint"
        for k in range(simhash.WORDS):
            word = f"cast(concat('0x', substr(m[i + {k}], {16 * half + 1}, 16)) as ubigint)::uhugeint"
            out = f"case when m[i + {k}] is null then {out} else {wrap(f'{wrap(f"({out}) + {word}")} * {mult}::uhugeint + {plus}::uhugeint')} end"
        return f"cast({out} as ubigint)"

    def mixed(x: str) -> str:
        return f"xor({x}, {x} >> 33)"

    def times(x: str, shift: int, factor: int) -> str:
        return f"cast({wrap(f'xor({x}, {x} >> {shift})::uhugeint * {factor}::uhugeint')} as ubigint)"

    bits = range(64)
    half = lambda h: " + ".join(f"(case when 2 * {h}{k} > total then {1 << (63 - k)}::ubigint else 0::ubigint end)" for k in bits)
    digits = lambda h: f"lpad(lower(to_hex({half(h)})), 16, '0')"
    distance = "bit_count(xor(a.x, b.x)::bit) + bit_count(xor(a.y, b.y)::bit)"
    likeness = "case when {0} = {1} then 1.0 else greatest(0.0, round(cos(pi() * (bit_count(xor({2}x, {3}x)::bit) + bit_count(xor({2}y, {3}y)::bit)) / 128), 6)) end"
    return f"""with recursive t as (select doc_id, coalesce(text, '') as text from documents),
    e as (select doc_id, text, coalesce(lead(text) over w, first_value(text) over (order by doc_id nulls first)) as following, coalesce(lead(doc_id) over w, first_value(doc_id) over (order by doc_id nulls first)) as next_id
      from t window w as (order by doc_id nulls first)),
    edits as (select doc_id, text, next_id, concat(substr(text, 1, length(text) - length(text) // 2), substr(following, 1, length(text) // 2)) as edited from e),
    said as materialized (select doc_id, 0 as kind, text from edits union all select doc_id, 1, edited from edits),
    words as (select doc_id, kind, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: md5(x)) as m from said),
    runs as (select doc_id, kind, m, unnest(range(1, greatest(len(m) - {simhash.WORDS - 2}, 2))) as i from words where len(m) > 0),
    raw as (select doc_id, kind, {number(0)} as x0, {number(1)} as y0 from runs),
    one as (select doc_id, kind, {times("x0", 31, 0x7FB5D329728EA185)} as x1, {times("y0", 31, 0x7FB5D329728EA185)} as y1 from raw),
    two as (select doc_id, kind, {times("x1", 27, 0x81DADEF4BC2DD44D)} as x2, {times("y1", 27, 0x81DADEF4BC2DD44D)} as y2 from one),
    terms as (select doc_id, kind, {mixed("x2")} as x, {mixed("y2")} as y, length(bin(count(*))) as w from two group by all),
    votes as (select doc_id, kind, sum(w) as total, {", ".join(f"sum(w * ((x >> {63 - k}) & 1)) as x{k}, sum(w * ((y >> {63 - k}) & 1)) as y{k}" for k in bits)} from terms group by 1, 2),
    prints as materialized (select s.doc_id, s.kind, coalesce({digits("x")} || {digits("y")}, repeat('0', 32)) as p from said s left join votes v using (doc_id, kind)),
    halves as materialized (select *, cast(concat('0x', substr(p, 1, 16)) as ubigint) as x, cast(concat('0x', substr(p, 17)) as ubigint) as y from prints),
    own as materialized (select distinct p, x, y from halves where kind = 0),
    links as materialized (select a.p as a, b.p as b from own a join own b on a.p <> b.p and {distance} <= {simhash.RADIUS}),
    reach(a, b) as (select p, p from own union select r.a, l.b from reach r join links l on l.a = r.b),
    classes as (select a, min(b) as near_class from reach group by 1), counts as (select a, count(*) as n_near from links group by 1)
    select d.doc_id, length(d.text) as n_chars, sha256(d.edited) as edited_sha256, o.p as fingerprint, f.p as edited_fingerprint,
      {likeness.format("o.p", "f.p", "o.", "f.")} as near_edited, {likeness.format("o.p", "g.p", "o.", "g.")} as near_next, coalesce(n_near, 0) as n_near, near_class
    from edits d join halves o on o.doc_id = d.doc_id and o.kind = 0 join halves f on f.doc_id = d.doc_id and f.kind = 1 join halves g on g.doc_id = d.next_id and g.kind = 0
    join classes c on c.a = o.p left join counts n on n.a = o.p"""


SQL = {"op1_quality_rules": quality_rules_sql(), "op3_warc": warc_sql(), "op9_chat_format": chat_sql(), "op10_url_filter": url_filter_sql(),
    "op11_simhash": simhash_sql(), "op12_conversation_repair": conversation_repair_sql(), "op13_fill_in_middle": fill_in_middle_sql()}
