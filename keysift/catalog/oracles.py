"""The registered queries in SQL, for comparison on another engine.

Written from the semantics, not from the Spark plans: regexes where Spark uses
string functions, window functions where Spark uses minima, a recursive walk
where Spark folds arrays.
"""

from __future__ import annotations

from keysift.catalog.queries import BROKEN
from keysift.functions.text import WHITE_SPACE
from keysift.model import INT, LIST, METADATA_BLOCKS, METADATA_TOP, PACKAGE_STRINGS, STRING
from keysift.operators.features import type_columns
from keysift.operators.messages import CHAT_LIMIT, TICKET_LIMIT
from keysift.sources.rules import Rule, read_packs

NL = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(final: str, **ctes: str) -> str:
    recursive = "RECURSIVE " if "walk" in ctes else ""
    body = ",\n".join(f"{name} AS {'' if name == 'walk' else 'MATERIALIZED '}({sql})" for name, sql in ctes.items())
    return f"WITH {recursive}{body}\n{final}"


_PLANTED = f"""
CASE doc_id % 8
 WHEN 0 THEN 'github_token = "' || substr(digest, 1, 40) || '"'
 WHEN 1 THEN '<string name="google_api_key">AIzaSy' || substr(digest, 1, 33) || '</string>'
 WHEN 2 THEN 'aws_id: AKIA' || upper(substr(digest, 1, 16))
 WHEN 3 THEN '{{"type": "service_account"}}'
 WHEN 4 THEN 'endpoint https://svc:' || substr(digest, 1, 12) || '@db.example.com/x'
 WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----'
 WHEN 6 THEN 'password=' || substr(digest, 1, 24)
 ELSE '' END || {NL} || text"""

_DOCS = f"""SELECT doc_id, source, lang, text AS raw, digest, {_PLANTED} AS text,
 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS app_key, substr(digest, 1, 32) AS APKHash
 FROM (SELECT *, sha256(text) AS digest FROM documents)"""

_FILES = "SELECT source AS app_key, CAST(doc_id AS VARCHAR) AS file_path, text FROM docs"
_DOC_FILES = "SELECT app_key, app_key || '.apk' AS file_path, text FROM docs"


def _lines(files: str = "files") -> str:
    return f"""SELECT app_key, file_path, CAST(i AS INTEGER) AS line_no, parts[i] AS line, i < len(parts) AS ended
 FROM (SELECT app_key, file_path, parts, unnest(range(1, len(parts) + 1)) AS i
       FROM (SELECT app_key, file_path, string_split(text, {NL}) AS parts FROM {files}))
 WHERE i < len(parts) OR parts[i] <> ''"""


_TRIM = f"trim({{0}}, {_q(WHITE_SPACE)})"
_TAGGED = _q(r"(?s)^[^>]*>(.+)<[^<]*$")
_QUOTED = _q(r'(?s)^[^"]*"([^"]*)"')
_COLON = _q(r"(?s)^.*:(.*)$")


def _secret(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, {_TAGGED}) THEN {_TRIM.format(f"regexp_extract({c}, {_TAGGED}, 1)")}
 WHEN regexp_matches({c}, {_QUOTED}) THEN regexp_extract({c}, {_QUOTED}, 1)
 WHEN contains({c}, ':') THEN {_TRIM.format(f"regexp_extract({c}, {_COLON}, 1)")}
 ELSE {c} END"""


def _findings(rules: list[Rule], source: str = "lines") -> str:
    """Every rule against every line; one constant pattern per distinct regex."""
    distinct = list(dict.fromkeys(r.regex for r in rules))
    subject = f"line || CASE WHEN ended THEN {NL} ELSE '' END"
    tests = ",\n".join(f"CASE WHEN regexp_matches(subject, {_q(rx)}) THEN {i} END" for i, rx in enumerate(distinct))
    values = ",\n".join(f"({distinct.index(r.regex)}, {_q(r.pack)}, {r.ordinal}, {_q(r.name)})" for r in rules)
    return f"""SELECT app_key, pack, ordinal, name AS Type, line_no AS LineNo, file_path AS FileLocation,
 name AS SecretType, {_secret("content")} AS SecretString
 FROM (SELECT app_key, file_path, line_no, {_TRIM.format("line")} AS content, unnest([{tests}]) AS rid
       FROM (SELECT *, {subject} AS subject FROM {source})) hit
 JOIN (VALUES {values}) AS rule(rid, pack, ordinal, name) USING (rid)"""


_RULES = read_packs()[0]
_DISTINCT = """SELECT app_key, pack, ordinal, Type, LineNo, FileLocation, SecretType, SecretString FROM (
 SELECT *, row_number() OVER (PARTITION BY app_key, SecretString
                              ORDER BY pack, ordinal, FileLocation, LineNo) AS place FROM findings) WHERE place = 1"""

_CORPUS = {"docs": _DOCS, "files": _FILES, "lines": _lines()}
_SCAN = {**_CORPUS, "findings": _findings(_RULES)}
_FOUND = {**_SCAN, "secrets": _DISTINCT}

# Badging, one line per row, then the last usable value per field -------------------

_BADGING = f"""SELECT 'src' || p_partkey AS app_key,
 'package: name=''com.' || replace(p_name, ' ', '.') || ''' versionCode=''' || p_partkey || ''' versionName=''' ||
 CASE WHEN p_partkey % 13 = 0 THEN p_size || ' beta' ELSE p_size || '.' || (p_partkey % 7) END ||
 ''' compileSdkVersion=''' || (p_size % 14 + 20) || ''' compileSdkVersionCodename=''13''' || {NL} ||
 CASE WHEN p_partkey % 5 <> 0 THEN 'sdkVersion:''' || (p_size % 9 + 16) || '''' || {NL} ELSE '' END ||
 'targetSdkVersion:''' || (p_size % 7 + 27) || '''' || {NL} ||
 'application: label=''' || p_brand || ''' icon=''res/icon.png''' || {NL} ||
 'supports-screens: ''small'' ''normal'' ''large''' || {NL} ||
 CASE WHEN p_partkey % 4 <> 0 THEN 'densities: ''160'' ''' || (p_size * 10) || '''' || {NL} ELSE '' END ||
 CASE WHEN p_partkey % 3 = 0 THEN 'alt-native-code: ''x86'' ''x86_64''' || {NL} ELSE 'native-code: ''arm64-v8a''' || {NL} END ||
 CASE WHEN p_partkey % 11 = 0 THEN 'uses-package: name=''org.' || replace(p_name, ' ', '.') || ''' a=''' || p_partkey ||
   ''' b=''2'' c=''31''' || {NL} ELSE '' END AS text FROM part"""
_BADGING_LINES = f"""SELECT app_key, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS line FROM (
 SELECT app_key, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT app_key, string_split(text, {NL}) AS parts FROM badging))"""
_RUN = _q("'[^\"]+'")


def _quoted(text: str) -> str:
    return f"replace(nullif(regexp_extract({text}, {_RUN}), ''), '''', '')"


def _last(word: str, value: str, empty: str = "''") -> str:
    return f"coalesce(arg_max({value}, pos) FILTER (contains(line, '{word}') AND {value} IS NOT NULL), {empty})"


def _token(n: int) -> str:
    return _quoted(f"string_split(line, ' ')[{n + 1}]")


_SEGMENT = _quoted("string_split(line, ':')[2]")
# A leading blank is outside the run, so a list is the run split at blanks.
_LIST = f"replace({_SEGMENT}, ' ', ',')"
_FACTS = f"""SELECT app_key, {_last('package', _token(1))} AS PackageName, {_last('package', _token(2))} AS VersionCode,
 {_last('package', _token(3))} AS VersionName, {_last('package', _token(4))} AS CompileSdkVersion,
 {_last('sdkVersion', _SEGMENT)} AS SdkVersion, {_last('targetSdkVersion', _SEGMENT)} AS TargetSdk,
 {_last('supports-screens', _LIST)} AS SupportScreens, {_last('densities', _LIST)} AS Densities,
 {_last('native-code', _LIST)} AS NativeCode FROM badging_lines GROUP BY app_key"""
_PACKAGES = {"badging": _BADGING, "badging_lines": _BADGING_LINES, "facts": _FACTS}

# Metadata: the expected fields of every document, by construction of the documents --


def _metadata() -> str:
    known = {
        "fileName": "s_name || '.apk'",
        "fileSize": "s_suppkey * 1000",
        "arscSize": "CAST(s_nationkey AS BIGINT)",
        "androidManifest_packageName": "'com.n' || s_nationkey",
        "androidManifest_numberOfActivities": "s_suppkey % 17",
        "androidManifest_NamesOfActivities": """'{"A' || s_suppkey || '","","","B \\"q\\""}'""",
        "androidManifest_usesMinSdkVersion": "CAST(s_nationkey + 10 AS VARCHAR)",
        "CertificateDatas_fileName": "'CERT.RSA'",
        "CertificateDatas_version": "CAST(s_nationkey % 4 AS BIGINT)",
        "resourceData_locale": """'{"en","l' || s_nationkey || '"}'""",
        "resourceData_menu": "s_suppkey % 3",
    }
    fields = list(METADATA_TOP) + [(f"{b}_{n}", k) for b, fs in METADATA_BLOCKS.items() for n, k in fs]
    columns = []
    for name, kind in fields:
        zero = {INT: "CAST(0 AS BIGINT)", LIST: "'{}'"}.get(kind, "''")
        value = f"CASE WHEN s_suppkey % 10 >= 8 THEN {zero} ELSE {known[name]} END" if name in known else zero
        columns.append(f"{value} AS {name}")
    return f"SELECT 'src' || s_suppkey AS app_key, {', '.join(columns)} FROM supplier"


# Reports and messages ------------------------------------------------------------------

_APPS = """SELECT app_key, app_key || '.apk' AS FileName, substr(sha256(app_key), 1, 32) AS APKHash
 FROM (SELECT DISTINCT source AS app_key FROM documents)"""
_JSON = """SELECT app_key, count(*) AS n_findings,
 CAST(to_json(list({'Type': Type, 'LineNo': LineNo, 'FileLocation': FileLocation, 'SecretType': SecretType,
  'SecretString': SecretString} ORDER BY pack, ordinal, FileLocation, LineNo)) AS VARCHAR) AS json
 FROM secrets GROUP BY app_key"""
_REPORT_CTES = {
    **_FOUND,
    **_PACKAGES,
    "apps": _APPS,
    "found_json": _JSON,
    "all_meta": _metadata(),
    "meta": "SELECT app_key, fileName, resourceData_menu AS menu FROM all_meta",
    "reports": """SELECT apps.app_key, apps.FileName, APKHash, coalesce(VersionName, '') AS APKVersion,
 coalesce(n_findings, 0) AS n_findings, coalesce(PackageName, '') AS PackageName,
 coalesce(meta.fileName, '') AS metadata_file, coalesce(menu, 0) AS menu, coalesce(json, 'null') AS SecretModel, Densities
 FROM apps LEFT JOIN facts USING (app_key) LEFT JOIN meta USING (app_key) LEFT JOIN found_json USING (app_key)""",
}

_BAR = f"'----------------' || {NL}"
_CHAT_HEAD = f"""'APK Name: ' || FileName || {NL} || 'App Version: ' || APKVersion || {NL} || 'Package Name: ' ||
 coalesce(PackageName, '') || {NL} || 'SHA1: ' || APKHash || {NL} || {NL} || 'Secrets in APK: ' || {NL} || {_BAR} ||
 n_findings || ' secrets found' || {NL} || {_BAR}"""
_CHAT_ENTRY = f"""'Secret Type: ' || Type || {NL} || 'Secret Value: ' || SecretString || {NL} || 'Secret Type: ' ||
 SecretType || {NL} || 'Line No: ' || LineNo || {NL} || 'File Location: ' || FileLocation || {NL} || {_BAR}"""
_TICKET_HEAD = f"""'h2. Secret scan report' || {NL} || 'h4. APK Name: ' || FileName || {NL} || 'h4. App Version: ' ||
 APKVersion || {NL} || 'h4. Package Name: ' || coalesce(PackageName, '') || {NL} || 'h4. SHA1: ' || APKHash || {NL} ||
 'h4. Secrets in APK:' || {NL} || {_BAR} || n_findings || ' secrets found' || {NL} || {_BAR}"""
_TICKET_ENTRY = f"""'{{noformat}}' || {NL} || ' === ' || Type || ' ===' || {NL} || 'Secret Value: ' || SecretString || {NL} ||
 'Line No: ' || LineNo || {NL} || 'File Location: ' || FileLocation || {NL} || '{{noformat}}'"""


def _messages(head: str, entry: str, limit: int) -> dict[str, str]:
    return {
        **_REPORT_CTES,
        "pieces": f"""SELECT app_key, CAST(0 AS BIGINT) AS n, {head} AS piece FROM reports UNION ALL
 SELECT app_key, row_number() OVER (PARTITION BY app_key ORDER BY pack, ordinal, FileLocation, LineNo), {entry} FROM secrets""",
        "walk": f"""SELECT app_key, n, 0 AS seq, strlen(piece) AS size FROM pieces WHERE n = 0 UNION ALL
 SELECT p.app_key, p.n, CASE WHEN w.size + strlen(p.piece) > {limit} THEN w.seq + 1 ELSE w.seq END,
  CASE WHEN w.size + strlen(p.piece) > {limit} THEN strlen(p.piece) ELSE w.size + strlen(p.piece) END
 FROM walk w JOIN pieces p ON p.app_key = w.app_key AND p.n = w.n + 1""",
        "messages": """SELECT app_key, CAST(seq AS INTEGER) AS seq, string_agg(piece, '' ORDER BY n) AS body
 FROM walk JOIN pieces USING (app_key, n) GROUP BY app_key, seq""",
    }


_CHAT = _messages(_CHAT_HEAD, _CHAT_ENTRY, CHAT_LIMIT)
_TICKET = _messages(_TICKET_HEAD, _TICKET_ENTRY, TICKET_LIMIT)

# Known content ----------------------------------------------------------------------------

_STORE = """SELECT app_key, APKHash, CAST(quality * 2 + toxic AS BIGINT) AS batch_id FROM docs JOIN labels USING (doc_id)"""
_FRESH = """SELECT min(app_key) AS app_key, APKHash, count(*) AS copies FROM docs
 WHERE APKHash NOT IN (SELECT APKHash FROM store) GROUP BY APKHash"""
_FIRST = """SELECT APKHash, batch_id, app_key FROM (SELECT *, row_number() OVER (
 PARTITION BY APKHash ORDER BY batch_id, app_key) AS place FROM store) WHERE place = 1"""
_KNOWN = {"docs": _DOCS, "store": _STORE}
# Two batches: labelled documents, then all of them.
_TWO = {
    "docs": _DOCS,
    "files": _DOC_FILES,
    "lines": _lines(),
    "findings": _findings(_RULES),
    "secrets": _DISTINCT,
    "store": "SELECT app_key, APKHash FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)",
    "fresh": _FRESH,
    "counts": "SELECT app_key, count(*) AS n_findings FROM secrets GROUP BY app_key",
}

_MESSAGES = """SELECT 'c' || (conv_id % 7) AS channel, conv_id * 1000 + turn AS msg_pos,
 conv_id || '.' || CAST(floor(turn / 2) AS BIGINT) AS ts, conv_id, turn, role || conv_id || '_' || turn AS base FROM conversations"""
_ATTACHED = """SELECT channel, msg_pos, ts, CAST(pos AS INTEGER) AS file_pos,
 'https://files.example.com/' || conv_id || '/' || base || ending AS url, base || ending AS name
 FROM messages JOIN (VALUES (0, 0, '.txt'), (0, 1, '.apk'), (1, 0, '.apk')) AS f(kind, pos, ending) ON turn % 3 = kind"""
_MAIL = {"messages": _MESSAGES, "attached": _ATTACHED}

_STREAM_RULES = [Rule("own.yml", 1, "Token", r'token = "[0-9a-f]{40}"'), Rule("own.yml", 2, "Comma pair", r"[a-z]+, [a-z]+, ")]

def _AS_APP(table: str) -> str:
    """A source's key as a document's."""
    return f"'d' || lpad(substr({table}.app_key, 4), 9, '0')"


def _meta_columns() -> str:
    """Every metadata field of the table m, zero-valued where an app has none."""
    fields = list(METADATA_TOP) + [(f"{b}_{n}", k) for b, fs in METADATA_BLOCKS.items() for n, k in fs]
    zero = {INT: "0", LIST: "'{}'", STRING: "''"}
    return ", ".join(f"coalesce(m.{n}, {zero[k]}) AS meta_{n}" for n, k in fields)


def _features() -> str:
    fields = list(METADATA_TOP) + [(f"{b}_{n}", k) for b, fs in METADATA_BLOCKS.items() for n, k in fs]
    columns = []
    for n, k in fields:
        if k == LIST:  # the lists of the documents hold 4, 2 or no elements
            size = {"androidManifest_NamesOfActivities": 4, "resourceData_locale": 2}.get(n, 0)
            columns.append(f"CAST(CASE WHEN coalesce(m.{n}, '{{}}') = '{{}}' THEN 0 ELSE {size} END AS INTEGER) AS meta_n_{n}")
        else:
            columns.append(f"coalesce(m.{n}, {0 if k == INT else repr('')}) AS meta_{n}")
    columns += [
        f"CAST(CASE WHEN coalesce({c}, '') = '' THEN 0 ELSE len(string_split({c}, ',')) END AS INTEGER) AS n_{c}"
        for c in ("SupportScreens", "Densities", "NativeCode")
    ]
    columns += [f"coalesce({c}, '') AS {c}" for c in PACKAGE_STRINGS]
    columns += [f"coalesce({c}, 0) AS {c}" for c in type_columns(_RULES).values()]
    return f"""SELECT CAST(0 AS BIGINT) AS batch_id, apps.app_key, apps.FileName AS file_name, APKHash, coalesce(VersionName, '') AS APKVersion,
 coalesce(n_findings, 0) AS n_findings, {', '.join(columns)}
 FROM apps LEFT JOIN facts USING (app_key) LEFT JOIN all_meta m USING (app_key) LEFT JOIN found_json USING (app_key)
 LEFT JOIN type_counts USING (app_key)"""


ORACLES: dict[str, str] = {
    "s2_corpus_files": _with(
        "SELECT app_key, file_path, strlen(text) AS n_bytes, substr(sha256(text), 1, 32) AS fingerprint FROM files", **_CORPUS
    ),
    "s2_corpus_folder": """SELECT lang || ' x' AS app_key, CASE doc_id % 3 WHEN 0 THEN 'apps' WHEN 1 THEN '_next' ELSE 'res' END AS folder,
 doc_id || ' ' || length(text) AS value FROM documents""",
    "s3_scannable_files": """SELECT source AS app_key, 'src/a.b/' || doc_id || '.txt' AS file_path, length(text) AS n_chars
 FROM documents WHERE lang NOT IN ('fr', 'de', 'es')""",
    "s3_ignored_files": """SELECT source || '/' || lang || '/' || folder || '/' || doc_id || ending AS file_path FROM (
 SELECT doc_id, source, lang, ['build', 'src/tmp', 'keep', 'src'][doc_id % 4 + 1] AS folder, ['.log', '.txt', '.xml'][doc_id % 3 + 1] AS ending FROM documents)
 WHERE NOT (lang IN ('fr', 'de') AND folder = 'build') AND NOT (lang = 'es' AND folder = 'src/tmp') AND NOT (lang = 'de' AND folder = 'keep' AND ending = '.xml')
 AND NOT (lang <> 'de' AND ending = '.log' AND doc_id % 10 <> 5)""",
    "s8_search_output": _with(
        "SELECT app_key, file_path, line_no, line FROM lines WHERE contains(line, ',')", **_CORPUS
    ),
    "p1_lines": _with("SELECT app_key, file_path, line_no, line FROM lines", **_CORPUS),
    "c1_scan": _with("SELECT * FROM findings", **_SCAN),
    "p3_multiline_rules": _with(
        f"""SELECT app_key, 'spanning.yml' AS pack, ordinal, Type, line_no AS LineNo, file_path AS FileLocation,
 Type AS SecretType, {_secret("content")} AS SecretString FROM (
 SELECT app_key, file_path, line_no, {_TRIM.format("line")} AS content, ordinal, Type FROM touched)""",
        **_CORPUS,
        pairs="""SELECT *, lead(line) OVER w AS below, lag(line) OVER w AS above FROM lines
 WINDOW w AS (PARTITION BY app_key, file_path ORDER BY line_no)""",
        touched="""SELECT app_key, file_path, line_no, line, 1 AS ordinal, 'Key with body' AS Type FROM pairs
 WHERE (line LIKE '%-----BEGIN RSA PRIVATE KEY-----' AND regexp_matches(below, '^[A-Za-z]'))
    OR (above LIKE '%-----BEGIN RSA PRIVATE KEY-----' AND regexp_matches(line, '^[A-Za-z]'))
 UNION ALL SELECT app_key, file_path, line_no, line, 2, 'Sentence break' FROM pairs
 WHERE (line LIKE '%.' AND regexp_matches(below, '^[A-Z][a-z]+ ')) OR (above LIKE '%.' AND regexp_matches(line, '^[A-Z][a-z]+ '))""",
    ),
    "p4_bad_rule_isolation": _with(
        """SELECT pack, ordinal, name, coalesce(n, 0) AS n_findings FROM (VALUES """
        + ", ".join(f"({_q(r.pack)}, {r.ordinal}, {_q(r.name)})" for r in BROKEN)
        + """) AS rule(pack, ordinal, name) LEFT JOIN (SELECT pack, ordinal, count(*) AS n FROM findings GROUP BY ALL) USING (pack, ordinal)""",
        **_CORPUS,
        findings=_findings([BROKEN[0], BROKEN[2]]),
    ),
    "p6_app_files": "SELECT doc_id, source || '.apk' AS name FROM documents WHERE lang = 'en'",
    "p8_attachments": _with("SELECT channel, msg_pos, ts, file_pos, url, name FROM attached", **_MAIL),
    "f1_extract_secret_lines": _with(
        f"SELECT file_path, line_no, {_secret('content')} AS secret FROM (SELECT *, {_TRIM.format('line')} AS content FROM lines)",
        **_CORPUS,
    ),
    "c2_extract_secret_pages": _with(
        f"SELECT file_path, line_no, {_secret('content')} AS secret FROM (SELECT *, {_TRIM.format('line')} AS content FROM lines)",
        files="SELECT 'web' AS app_key, CAST(page_id AS VARCHAR) AS file_path, html AS text FROM pages",
        lines=_lines(),
    ),
    "f2_trim_space": f"SELECT conv_id, turn, {_TRIM.format('text')} AS trimmed FROM conversations",
    "f3_base_name": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '[^/]*$') ELSE url END AS base_name FROM pages""",
    "f4_last_segment": "SELECT page_id, regexp_extract(url, '[^/]*$') AS segment FROM pages",
    "f5_report_names": _with(
        """SELECT app_key, app_key || '.apk_' || VersionName || '.json' AS report_name,
 app_key || '.apk_Secrets_' || VersionName || '.json' AS findings_name FROM facts""",
        **_PACKAGES,
    ),
    "f6_json_name": _with(
        "SELECT msg_pos, file_pos, regexp_replace(name || '.apk', '[.]apk', '.json', 'g') AS json_name FROM attached", **_MAIL
    ),
    "f7_fingerprint": "SELECT doc_id, substr(sha256(text), 1, 32) AS fingerprint FROM documents",
    "f8_metadata": _metadata(),
    "f9_findings_json": _with("SELECT app_key, 0 AS part, json AS findings_json FROM found_json", **_FOUND, found_json=_JSON),
    "f10_parse_findings": _with(
        "SELECT app_key, Type, LineNo, FileLocation, SecretType, SecretString FROM secrets", **_FOUND
    ),
    "f11_array_text": f"""SELECT conv_id, turn,
 '{{"' || replace(replace(replace(replace(text, {NL}, '"'), '\\', '\\\\'), '"', '\\"'), ' ', '","') || '"}}' AS as_text,
 replace(replace(text, {NL}, '"'), ' ', '|') AS back FROM conversations""",
    "f12_badging_pieces": _with(
        f"""SELECT app_key, pos, {_quoted('line')} AS quoted, string_split(line, ' ')[2] AS token_1,
 string_split(line, ' ')[5] AS token_4, string_split(line, ':')[2] AS segment,
 coalesce(len(string_split(string_split(line, ':')[2], ' ')), 0) AS n_items FROM badging_lines""",
        badging=_BADGING,
        badging_lines=_BADGING_LINES,
    ),
    "f16_byte_length": "SELECT conv_id, CAST(turn AS VARCHAR) AS turn, strlen(text) AS n_bytes FROM conversations",
    "c3_package_facts": _with("SELECT * FROM facts", **_PACKAGES),
    "c4_reports": _with(
        """SELECT app_key, FileName, APKHash, APKVersion, n_findings, PackageName, metadata_file, menu, SecretModel FROM reports""",
        **_REPORT_CTES,
    ),
    "c5_chat_messages": _with("SELECT app_key, seq, body FROM messages", **_CHAT),
    "c5_chat_messages_in_parts": _with("SELECT app_key, seq, body FROM messages", **_CHAT),
    "c6_ticket_messages": _with("SELECT app_key, seq, body FROM messages", **_TICKET),
    "c6_tickets_of_one_app": _with(
        "SELECT app_key, seq, body FROM messages",
        **{
            **_messages(_TICKET_HEAD, _TICKET_ENTRY, TICKET_LIMIT),
            "files": "SELECT 'all' AS app_key, CAST(doc_id AS VARCHAR) AS file_path, text FROM docs",
            "apps": "SELECT 'all' AS app_key, 'all.apk' AS FileName, '0' AS APKHash",
        },
    ),
    "c7_scan_batch": _with(
        f"""SELECT fresh.app_key, fresh.app_key || '.apk' AS FileName, APKHash, coalesce(n_findings, 0) AS n_findings,
 coalesce(PackageName, '') AS PackageName, coalesce(fileName, '') AS metadata_file
 FROM fresh LEFT JOIN counts USING (app_key) LEFT JOIN facts ON {_AS_APP("facts")} = fresh.app_key
 LEFT JOIN all_meta ON {_AS_APP("all_meta")} = fresh.app_key""",
        **_TWO,
        **_PACKAGES,
        all_meta=_metadata(),
    ),
    "k7_duplicate_replies": _with(
        """SELECT docs.app_key, docs.APKHash, first.app_key AS reply_app, first.app_key || '.apk' AS FileName,
 coalesce(n_findings, 0) AS n_findings
 FROM docs JOIN (SELECT APKHash, min(app_key) AS app_key FROM store GROUP BY APKHash
                 UNION ALL SELECT APKHash, app_key FROM fresh) AS first USING (APKHash)
 LEFT JOIN counts ON counts.app_key = first.app_key""",
        **_TWO,
    ),
    "j1_regex_join": _with(
        "SELECT app_key, FileLocation, LineNo, pack, ordinal, Type FROM findings",
        **_CORPUS,
        findings=_findings(_RULES),
    ),
    "j2_new_content": _with("SELECT app_key, APKHash, copies FROM fresh", **_KNOWN, fresh=_FRESH),
    "j2_known_content": _with(
        """SELECT docs.app_key, APKHash, batch_id AS reply_batch, first.app_key AS reply_app FROM docs JOIN first USING (APKHash)""",
        **_KNOWN,
        first=_FIRST,
    ),
    "w2_first_stored": _with(_FIRST, **_KNOWN),
    "w1_last_attachment": _with(
        """SELECT channel, ts, arg_max(url, msg_pos * 10 + file_pos) AS url, arg_max(name, msg_pos * 10 + file_pos) AS name
 FROM attached GROUP BY channel, ts""",
        **_MAIL,
    ),
    "d9_ticket_requests": """SELECT 'SEC-' || page_id AS ticket_id, url || '.apk' AS file_url,
 regexp_extract(url || '.apk', '[^/]*$') AS FileName FROM pages WHERE url NOT LIKE '%?%'""",
    "a1_distinct_secrets": _with("SELECT * FROM secrets", **_FOUND),
    "a2_count_by_app": _with("SELECT app_key, count(*) AS n_findings FROM secrets GROUP BY app_key", **_FOUND),
    "a6_count_by_type": _with("SELECT Type, count(*) AS n_findings FROM findings GROUP BY Type", **_SCAN),
    "a6_count_by_rule": _with(
        "SELECT pack, ordinal, name, coalesce(n, 0) AS n_findings FROM (VALUES "
        + ", ".join(f"({_q(r.pack)}, {r.ordinal}, {_q(r.name)})" for r in _RULES)
        + ") AS rule(pack, ordinal, name) LEFT JOIN (SELECT pack, ordinal, count(*) AS n FROM findings GROUP BY ALL) USING (pack, ordinal)",
        **_SCAN,
    ),
    "a6_count_with_subtotals": _with(
        """SELECT pack, Type, CAST(grouping_id(pack, Type) AS INTEGER) AS level, count(*) AS n_findings, count(DISTINCT app_key) AS n_apps
 FROM findings GROUP BY ROLLUP (pack, Type)""",
        **_SCAN,
    ),
    "u1_union_of_packs": _with("SELECT app_key, pack, count(*) AS n_findings FROM findings GROUP BY app_key, pack", **_SCAN),
    "k1_store_round_trip": _with(
        """SELECT CAST(b AS BIGINT) AS batch_id, app_key, APKHash, APKVersion, n_findings
 FROM reports CROSS JOIN (VALUES (0), (1)) AS batch(b)""",
        **_REPORT_CTES,
    ),
    "s6_store_findings": _with(
        "SELECT app_key, Type, LineNo, FileLocation, SecretType, SecretString FROM secrets", **_FOUND
    ),
    "s6_retro_scan": _with(
        f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY app_key, SecretString ORDER BY pack, ordinal, FileLocation, LineNo) AS place
 FROM findings WHERE pack <> {_q(_RULES[0].pack)}) AS late WHERE place = 1 AND NOT EXISTS
 (SELECT 1 FROM findings AS old WHERE old.pack = {_q(_RULES[0].pack)} AND old.app_key = late.app_key AND old.SecretString = late.SecretString)""",
        **_SCAN,
    ),
    "w3_last_report": _with(
        """SELECT CAST(0 AS BIGINT) AS batch_id, app_key, APKHash, n_findings FROM reports ORDER BY app_key DESC LIMIT 1""",
        **_REPORT_CTES,
    ),
    "k2_report_documents": _with(
        f"""SELECT apps.app_key, apps.FileName || '_' || coalesce(VersionName, '') || '.json' AS document, apps.FileName, APKHash,
 coalesce(json, 'null') AS SecretModel, {', '.join(f"coalesce({c}, '') AS {c}" for c in (*PACKAGE_STRINGS, 'SupportScreens', 'Densities', 'NativeCode'))},
 {_meta_columns()} FROM apps LEFT JOIN facts USING (app_key) LEFT JOIN all_meta m USING (app_key) LEFT JOIN found_json USING (app_key)""",
        **_REPORT_CTES,
    ),
    "k3_findings_documents": _with(
        "SELECT FileName || '_Secrets_' || APKVersion || '.json' AS document, SecretModel AS body FROM reports", **_REPORT_CTES
    ),
    "k3_exported_files": _with(
        "SELECT FileName || '_Secrets_' || APKVersion || '.json' AS document, SecretModel AS body FROM reports", **_REPORT_CTES
    ),
    "k4_dual_write": _with(
        """SELECT folder, CAST(b AS BIGINT) AS batch_id, APKHash, 'app.apk_' || kind || APKVersion || '.json' AS document, SecretModel,
 CASE WHEN kind = '' THEN PackageName END AS PackageName
 FROM reports CROSS JOIN (VALUES ('backup'), ('results')) AS f(folder) CROSS JOIN (VALUES (0), (1)) AS batch(b)
 CROSS JOIN (VALUES (''), ('Secrets_')) AS k(kind)""",
        **_REPORT_CTES,
    ),
    "x1_version_comparison": _with(
        """SELECT PackageName, VersionCode, before, SecretString, CASE WHEN here AND there THEN 'kept' WHEN here THEN 'added' ELSE 'removed' END AS change
 FROM (SELECT v.package AS PackageName, CAST(v.version AS VARCHAR) AS VersionCode, CAST(v.before AS VARCHAR) AS before, s.secret AS SecretString,
   EXISTS (SELECT 1 FROM found f WHERE f.version = v.version AND f.secret = s.secret) AS here,
   EXISTS (SELECT 1 FROM found f WHERE f.version = v.before AND f.secret = s.secret) AS there
  FROM versions v JOIN (SELECT DISTINCT package, secret FROM found) s USING (package)) WHERE here OR there""",
        **_FOUND,
        found="""SELECT DISTINCT CAST(substr(app_key, 4) AS BIGINT) AS version, 'pkg' || (CAST(substr(app_key, 4) AS BIGINT) % 4) AS package,
 Type || ':' || substr(SecretString, 1, 1) AS secret FROM secrets""",
        versions="""SELECT version, package, lag(version) OVER (PARTITION BY package ORDER BY version) AS before FROM (
 SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS version, 'pkg' || (CAST(substr(source, 4) AS BIGINT) % 4) AS package FROM documents)""",
    ),
    "x1_secret_runs": _with(
        """SELECT package AS PackageName, secret AS SecretString, CAST(row_number() OVER w AS INTEGER) AS run, CAST(first AS VARCHAR) AS first_version,
 CAST(last AS VARCHAR) AS last_version, n AS n_versions, row_number() OVER w > 1 AS returned, last < newest AS gone
 FROM (SELECT package, secret, min(version) AS first, max(version) AS last, count(*) AS n, any_value(newest) AS newest FROM
  (SELECT *, sum(CASE WHEN earlier THEN 0 ELSE 1 END) OVER (PARTITION BY package, secret ORDER BY version) AS island FROM
   (SELECT f.*, v.newest, coalesce(lag(f.version) OVER (PARTITION BY f.package, f.secret ORDER BY f.version) = v.before, false) AS earlier
    FROM found f JOIN versions v USING (version))) GROUP BY package, secret, island)
 WINDOW w AS (PARTITION BY package, secret ORDER BY first)""",
        **_FOUND,
        found="""SELECT DISTINCT CAST(substr(app_key, 4) AS BIGINT) AS version, 'pkg' || (CAST(substr(app_key, 4) AS BIGINT) % 4) AS package,
 SecretString AS secret FROM secrets""",
        versions="""SELECT version, lag(version) OVER (PARTITION BY version % 4 ORDER BY version) AS before, max(version) OVER (PARTITION BY version % 4) AS newest FROM (
 SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS version FROM documents)""",
    ),
    "x2_feature_table": _with(
        _features(),
        **_REPORT_CTES,
        type_counts="SELECT app_key, "
        + ", ".join(f"count(*) FILTER (Type = {_q(t)}) AS {c}" for t, c in type_columns(_RULES).items())
        + " FROM secrets GROUP BY app_key",
    ),
    "k5_chat_notifications": _with(
        """SELECT 'C1' AS channel, '17.' || app_key AS thread_ts, app_key, seq, '```' || body || '```' AS body FROM messages""",
        **_CHAT,
    ),
    "k6_ticket_notifications": _with("SELECT 'SEC-' || app_key AS ticket_id, seq, body FROM messages", **_TICKET),
    "t1_incremental_scan": _with("SELECT * FROM findings", **_SCAN),
    "t3_uploads_over_batches": _with(
        f"""SELECT app_key, file AS FileName, coalesce(n, 0) AS n_findings FROM uploads LEFT JOIN
 (SELECT app_key, count(DISTINCT SecretString) AS n FROM findings GROUP BY app_key) USING (app_key)""",
        docs=_DOCS,
        starts="""SELECT source, doc_id // 20 % 2 AS half, source || '@' || strftime(make_timestamp(1000000 * (1600000000 + min(doc_id % 50 * 60) + any_value(doc_id // 20 % 2) * 43200)), '%Y-%m-%dT%H:%M:%S.%g') AS app_key
 FROM docs GROUP BY source, doc_id // 20 % 2""",
        uploads="SELECT app_key, source || '.apk' AS file FROM starts",
        files="SELECT starts.app_key, CAST(doc_id AS VARCHAR) AS file_path, text FROM docs JOIN starts ON starts.source = docs.source AND half = doc_id // 20 % 2",
        lines=_lines(),
        findings=_findings([r for r in _RULES if r.pack == _RULES[0].pack]),
    ),
    "t2_rejection_within_horizon": _with(
        """SELECT APKHash, day FROM walk WHERE day IS NOT NULL""",
        docs=_DOCS,
        days="SELECT DISTINCT APKHash, doc_id % 6 AS day FROM docs",
        walk="""SELECT APKHash, min(day) AS day FROM days GROUP BY APKHash
 UNION ALL SELECT w.APKHash, (SELECT min(d.day) FROM days d WHERE d.APKHash = w.APKHash AND d.day > w.day + 3) FROM walk w WHERE w.day IS NOT NULL""",
    ),
    "t2_stream_reports": _with(
        f"""SELECT first.app_key, first.app_key || '.apk' AS FileName, APKHash, coalesce(n_findings, 0) AS n_findings,
 coalesce(PackageName, '') AS PackageName, coalesce(fileName, '') AS metadata_file FROM
 (SELECT arg_min(app_key, (doc_id % 3) * 1000000000 + doc_id) AS app_key, APKHash FROM docs GROUP BY APKHash) AS first LEFT JOIN
 (SELECT app_key, count(DISTINCT SecretString) AS n_findings FROM findings GROUP BY app_key) USING (app_key)
 LEFT JOIN facts ON {_AS_APP("facts")} = first.app_key LEFT JOIN all_meta ON {_AS_APP("all_meta")} = first.app_key""",
        **_PACKAGES,
        all_meta=_metadata(),
        docs=_DOCS,
        files="SELECT app_key, app_key || '.apk' AS file_path, raw AS text FROM docs",
        lines=_lines(),
        findings=_findings(_STREAM_RULES),
    ),
}
