"""Security rules over lines: a table of patterns, one finding a line and type.

Line rules look at one line; context rules also at lines around it, which are
in the same row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions import text as tx


@dataclass(frozen=True)
class Rule:
    """``patterns``: (pattern, message), the first that matches counts.  ``guard``: a pattern the line needs as well;
    ``unless``: one it must not have; ``code_only``: comment lines don't count; ``surer``: (pattern, confidence).
    ``hints``: texts in lower case, one of which a line with a match has; ``needs``: for each pattern, characters that all are
    in a match.  Both only spare regular expressions work, on long lines above all."""

    type: str
    cwe: str
    severity: str
    confidence: float
    patterns: tuple[tuple[str, str], ...]
    guard: str = ""
    unless: str = ""
    code_only: bool = False
    surer: tuple[str, float] = ("", 0.0)
    hints: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


_LOG = r"(?:log|logger|LOG|LOGGER)\s*\.\s*(?:info|debug|warn|error|trace|fatal)\s*\("
_SQL = r"(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM|SET)"

# Types, CWE numbers, severities, confidences, patterns and messages.
RULES = (
    Rule("SQL_INJECTION", "CWE-89", "ERROR", 0.9, (
        (rf'(?i)(?:"[^"]*{_SQL}\b[^"]*"\s*\+)|(?:\+\s*"[^"]*{_SQL}\b)',
         "String concatenation in SQL query detected. This may allow SQL injection."),
        (rf'(?i)(?:"[^"]*{_SQL}[^"]*\$\{{)|(?:\$"[^"]*{_SQL})',
         "String interpolation in SQL query detected. This may allow SQL injection."),
        (r'(?:".*\+)|(?:\+.*")', "Possible string concatenation near SQL keyword. Verify query is parameterized."),
    ), guard=r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE|UNION)\b",
        unless=r"(?i)(?:PreparedStatement|@Query\s*\(.*[:?]\w+|setString|setInt|setLong|setParameter|\?\s*,)", hints=('"',), needs=('"+', '"$', '"+')),
    Rule("XSS", "CWE-79", "ERROR", 0.7, (
        (r"innerHTML\s*=", "Assignment to innerHTML can lead to XSS if the value is not sanitized."),
        (r"document\.write\s*\(", "document.write() can introduce XSS vulnerabilities."),
        (r"\.html\s*\((?!.*sanitize)", "jQuery .html() can introduce XSS if the value is not sanitized."),
        (r"outerHTML\s*=", "Assignment to outerHTML can lead to XSS."),
        (r"v-html\s*=", "Vue v-html directive renders raw HTML and can lead to XSS."),
        (r"dangerouslySetInnerHTML", "React dangerouslySetInnerHTML can introduce XSS vulnerabilities."),
    ), hints=("html", "document.write")),
    Rule("HARDCODED_SECRET", "CWE-798", "ERROR", 0.9, (
        (r'(?i)(?:password|passwd|pwd)\s*=\s*"[^"]{3,}"', "Hardcoded password detected."),
        (r'(?i)api[_-]?key\s*=\s*"[^"]{3,}"', "Hardcoded API key detected."),
        (r'(?i)(?:secret|client[_-]?secret)\s*=\s*"[^"]{3,}"', "Hardcoded secret detected."),
        (r'(?i)(?:token|auth[_-]?token|access[_-]?token)\s*=\s*"[^"]{3,}"', "Hardcoded token detected."),
        (r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", "Possible AWS access key detected."),
        (r'(?i)private[_-]?key\s*=\s*"[^"]{3,}"', "Hardcoded private key detected."),
    ), unless=r'(?i)(?:""|"xxx"|"TODO"|"changeme"|"password"|"change_me"|"your[_-]|"example|"placeholder|"dummy|"test|"fake|"sample|\{[^{}]+\}|\{[^{}]*\{\}|<[^<>]+>|<[^<>]*<>)',
        code_only=True, hints=('"', "a3t", "akia", "agpa", "aida", "aroa", "aipa", "anpa", "anva", "asia")),
    Rule("PATH_TRAVERSAL", "CWE-22", "ERROR", 0.7, (
        (r"new\s+File\s*\(\s*(?:request\.|userInput|params|args|input)", "User input used directly in File constructor — potential path traversal."),
        (r"Paths\.get\s*\(\s*(?:request\.|userInput|params)", "User input used directly in Paths.get() — potential path traversal."),
        (r"(?:readFile|writeFile|createReadStream|createWriteStream|open)\s*\(\s*(?:req\.|request\.|params\.|args)",
         "User-controlled value used in file system operation — potential path traversal."),
        (r"\.\.(/|\\\\)", "Literal path traversal sequence detected."),
    ), surer=(r"request\.|req\.", 0.9), hints=("file", "paths", "stream", "open", "..")),
    Rule("COMMAND_INJECTION", "CWE-78", "ERROR", 0.9, (
        (r"Runtime\s*\.\s*(?:getRuntime\s*\(\s*\)\s*\.\s*)?exec\s*\(.*\+", "String concatenation in Runtime.exec() — potential command injection."),
        (r"ProcessBuilder\s*\(.*\+", "String concatenation in ProcessBuilder — potential command injection."),
        (r"Runtime\s*\.\s*(?:getRuntime\s*\(\s*\)\s*\.\s*)?exec\s*\(\s*(?:request|userInput|params|input)", "User input passed directly to Runtime.exec()."),
        (r"ProcessBuilder\s*\(\s*(?:request|userInput|params|input)", "User input passed directly to ProcessBuilder."),
        (r"(?:child_process|exec|execSync|spawn)\s*\(.*\+", "String concatenation in shell execution — potential command injection."),
    ), hints=("exec", "processbuilder", "child_process", "spawn"), needs=("+", "+", "", "", "+")),
    Rule("INSECURE_DESERIALIZATION", "CWE-502", "ERROR", 0.7, (
        (r"ObjectInputStream", "ObjectInputStream usage detected — may allow insecure deserialization of untrusted data."),
        (r"\.readObject\s*\(", "readObject() call detected — ensure the input stream is from a trusted source."),
        (r"XMLDecoder", "XMLDecoder usage detected — may allow insecure deserialization."),
        (r"(?:readUnshared|readResolve)\s*\(", "Java deserialization method detected — verify data source is trusted."),
    ), hints=("objectinputstream", "readobject", "xmldecoder", "readunshared", "readresolve")),
    Rule("WEAK_CRYPTO", "CWE-327", "WARNING", 0.9, (
        (r'MessageDigest\s*\.\s*getInstance\s*\(\s*"MD5"', "MD5 is cryptographically broken. Do not use for security purposes."),
        (r'MessageDigest\s*\.\s*getInstance\s*\(\s*"SHA-?1"', "SHA-1 is deprecated for security use. Use SHA-256 or stronger."),
        (r'Cipher\s*\.\s*getInstance\s*\(\s*"DES', "DES is insecure due to its short key length. Use AES instead."),
        (r"Cipher\s*\.\s*getInstance\s*\([^)]*ECB", "ECB mode does not provide semantic security. Use CBC, GCM, or another authenticated mode."),
        (r"(?i)\bDESede\b", "Triple DES (3DES) is deprecated. Use AES-256 instead."),
        (r"(?i)\bRC4\b", "RC4 is broken. Use AES-GCM or ChaCha20 instead."),
    ), hints=("messagedigest", "cipher", "desede", "rc4")),
    Rule("OPEN_REDIRECT", "CWE-601", "ERROR", 0.9, (
        (r"redirect\s*\(\s*request\s*\.\s*getParameter\s*\(", "Redirect uses user-supplied parameter directly — open redirect risk."),
        (r"sendRedirect\s*\(\s*(?:request\.|params\.|userInput|input)", "sendRedirect() with user input — open redirect risk."),
        (r"(?:redirect|sendRedirect|forward)\s*\(.*\+.*(?:request|params|getParameter)", "Redirect target built with user input — open redirect risk."),
        (r"(?:Location|location)\s*[:=]\s*(?:req\.|request\.|params\.)", "Location header set from user input — open redirect risk."),
    ), hints=("redirect", "forward", "ocation")),
    Rule("LOG_INJECTION", "CWE-117", "WARNING", 0.7, (
        (rf"{_LOG}\s*(?:request\.|userInput|params\.|input\.|req\.)", "User input logged directly — may allow log injection or log forging."),
        (rf"{_LOG}.*\+\s*(?:request|userInput|params|input|req)\b", "User input concatenated into log statement — may allow log injection."),
    ), hints=("log",), needs=("", "+")),
    Rule("SENSITIVE_DATA_EXPOSURE", "CWE-532", "ERROR", 0.7, (
        (rf"{_LOG}.*(?i:password|passwd|pwd|creditCard|credit_card|ccNumber|ssn|socialSecurity)", "Sensitive data (password/credit card/SSN) may be written to logs."),
        (rf"{_LOG}.*(?i:token|secret|apiKey|api_key|private_key|privateKey)", "Sensitive credential data may be written to logs."),
        (r"(?:println|print|printf|System\.out|System\.err|console\.log)\s*\(.*(?i:password|secret|token|apiKey|creditCard|ssn)",
         "Sensitive data may be printed to standard output."),
    ), code_only=True, hints=("log", "print", "system.")),
)
WEAK_SQL = 0.5
IP = r"(?<![.\d])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![.\d])"
#: What every address has.
IP_LIKE = r"\d\.\d"
URL_IP = r"(?:https?://)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
IGNORED_IPS = ("127.0.0.1", "0.0.0.0", "255.255.255.255", "1.0.0.0")
CONTROLLER = r"@(?:RestController|Controller)\b"
ENDPOINT = r"@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\b"
AUTH = r"@(?:PreAuthorize|Secured|RolesAllowed|Authenticated|RequiresAuthentication|RequiresPermissions|AuthenticationPrincipal|WithMockUser)\b"
RANDOM = r"(?:java\.util\.Random|new\s+Random\s*\()"
RANDOM_CONTEXT = r"(?i)(?:token|password|secret|auth|session|nonce|salt|key|otp|csrf|captcha)"
XML_FACTORY = r"(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|TransformerFactory|SchemaFactory)\s*\.\s*newInstance\s*\("
XML_SAFE = (
    r"(?:setFeature|setProperty|setAttribute)\s*\(.*(?:FEATURE_SECURE_PROCESSING|disallow-doctype-decl|"
    r"external-general-entities|external-parameter-entities|XMLConstants\.ACCESS_EXTERNAL)"
)
#: One of them is in each match of an endpoint, a random number and an XML factory.
TRIGGERS = ("Mapping", "Random", "newInstance")
TEST_MARKS = ("/test/", "/tests/", "test/")
TEST_ENDS = ("test.kt", "test.java", ".spec.ts", ".test.ts", "_test.go", "_test.py")


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for mark in TEST_MARKS:
        found = found | low.contains(mark)
    for end in TEST_ENDS:
        found = found | low.endswith(end)
    return found


def _hit(kind: str, cwe: str, severity: Column, confidence: Column, message: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(cwe).alias("cwe"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), message.alias("message"),
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def hinted(rule: Rule) -> Column:
    """Does the line, lower-cased as ``low``, have one of the rule's hints?"""
    out = F.lit(False)
    for hint in rule.hints:
        out = out | F.col("low").contains(hint)
    return out


def _line_rule(rule: Rule, line: Column, comment: Column, test: Column) -> Column:
    """The finding of a line, or null."""
    needs = rule.needs or ("",) * len(rule.patterns)
    message = F.coalesce(*[F.when(_all([line.contains(c) for c in need] + [line.rlike(p)]), F.lit(m)) for (p, m), need in zip(rule.patterns, needs, strict=True)])
    sure = F.lit(rule.confidence)
    if rule.surer[0]:
        sure = F.when(line.rlike(rule.surer[0]), rule.surer[1]).otherwise(sure)
    if rule.type == "HARDCODED_SECRET":
        sure = F.when(test, 0.4).otherwise(sure)
    if rule.type == "SQL_INJECTION":
        sure = F.when(message == rule.patterns[-1][1], WEAK_SQL).otherwise(sure)
    # in this order: what costs little, or is seldom true, spares the rest
    tests = [hinted(rule)] + ([~comment] if rule.code_only else []) + ([line.rlike(rule.guard)] if rule.guard else [])
    tests += [message.isNotNull()] + ([~line.rlike(rule.unless)] if rule.unless else [])
    return F.when(_all(tests), _hit(rule.type, rule.cwe, F.lit(rule.severity), sure, message))


def _ip_rule(line: Column, comment: Column) -> Column:
    found = F.get(F.filter(tx.extract_all(line, IP), lambda ip: ~ip.isin(*IGNORED_IPS) & ~ip.startswith("0.")), F.lit(0))
    in_url = line.rlike(URL_IP)
    dotted = line.contains(".") & line.rlike(IP_LIKE)
    said = F.concat(F.when(in_url, "Hardcoded URL with IP address '").otherwise("Hardcoded IP address '"), found, F.lit("' detected."))
    return F.when(dotted & ~comment & found.isNotNull(), _hit("HARDCODED_IP", "CWE-1051", F.lit("WARNING"), F.when(in_url, 0.9).otherwise(0.7), said))


def line_findings(lines: DataFrame) -> DataFrame:
    """Findings of the line rules over (path, language, line_no, line); narrow."""
    line, trimmed = F.col("line"), tx.trim(F.col("line"))
    low = F.explode(F.array(F.lower(line)))  # a generator: lower-cased once
    marked = lines.select("path", "line_no", "line", tx.starts_any(trimmed, ("//", "*", "#")).alias("comment"), is_test_file(F.col("path")).alias("test"), low.alias("low"))
    some = line.contains(".") & line.rlike(IP_LIKE)
    for rule in RULES:
        some = some | hinted(rule)
    hits = [_line_rule(r, line, F.col("comment"), F.col("test")) for r in RULES] + [_ip_rule(line, F.col("comment"))]
    found = marked.where(some).select("path", "line_no", F.explode(F.array(*hits)).alias("h"))
    return found.where("h is not null").select("path", "line_no", "h.*")


def context_findings(files: DataFrame) -> DataFrame:
    """Findings that look at the lines around: missing auth, insecure random, XML entities."""
    # a text without one of these is not split
    rows = tx.with_lines(files.where(tx.has_any(F.col("text"), TRIGGERS)) if "text" in files.columns else files)
    lines = F.col("lines")
    controller = F.exists(lines, lambda l: l.rlike(CONTROLLER))
    guarded = F.exists(lines, lambda l: tx.trim(l).startswith("@") & l.rlike(AUTH) & ~l.rlike(ENDPOINT))

    def judge(l: Column, i: Column) -> Column:
        n = i + 1
        unsafe = l.rlike(ENDPOINT) & ~F.exists(tx.around(lines, n, 3, -1), lambda x: x.rlike(AUTH))
        near = F.exists(tx.around(lines, n, 5, 5), lambda x: x.rlike(RANDOM_CONTEXT))
        open_xml = l.rlike(XML_FACTORY) & ~F.exists(F.slice(lines, n + 1, 10), lambda x: x.rlike(XML_SAFE))
        return F.filter(F.array(
            F.when(F.col("open_endpoints") & unsafe, _hit("MISSING_AUTH", "CWE-306", F.lit("WARNING"), F.lit(0.7), F.lit("Endpoint mapping without authentication annotation. Ensure this endpoint is intentionally public."))),
            F.when(l.rlike(RANDOM), _hit("INSECURE_RANDOM", "CWE-330", F.when(near, "WARNING").otherwise("INFO"), F.when(near, 0.9).otherwise(0.5),
                   F.when(near, "java.util.Random used in a security-sensitive context. It is not cryptographically secure.").otherwise("java.util.Random detected. If used for security purposes, replace with SecureRandom."))),
            F.when(open_xml, _hit("XXE", "CWE-611", F.lit("ERROR"), F.lit(0.7), F.lit("XML parser factory created without disabling external entities. This may allow XXE attacks."))),
        ), lambda h: h.isNotNull())

    triggers = F.exists(lines, lambda l: l.rlike(f"{ENDPOINT}|{RANDOM}|{XML_FACTORY}"))
    marked = rows.where(triggers).withColumn("open_endpoints", controller & ~guarded)
    per_line = marked.select("path", F.explode(F.transform(lines, lambda l, i: F.struct((i + 1).alias("line_no"), judge(l, i).alias("hits")))).alias("x"))
    found = per_line.select("path", F.col("x.line_no").alias("line_no"), F.explode_outer("x.hits").alias("h"))
    return found.where(F.col("h.type").isNotNull()).select("path", "line_no", "h.*")


def security_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, type, cwe, severity, confidence, message) of all fourteen types."""
    return line_findings(tx.explode_lines(files)).unionByName(context_findings(files))


def crosstab(findings: DataFrame) -> DataFrame:
    """Counts by type and severity, with a TOTAL row."""
    def count(severity: str) -> Column:
        return F.count_if(F.col("severity") == severity).alias(severity.lower())

    kind = F.when(F.grouping("type") == 1, "TOTAL").otherwise(F.col("type")).alias("type")
    return findings.rollup("type").agg(kind.alias("kind"), count("ERROR"), count("WARNING"), count("INFO"), F.count(F.lit(1)).alias("total")).select(F.col("kind").alias("type"), "error", "warning", "info", "total")
