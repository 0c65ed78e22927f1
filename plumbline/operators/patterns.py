"""Patterns in functions that call for special tests, and concurrency primitives: predicates over text and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls whose name in a body shows a pattern.
FILE_CALLS = ("os.ReadFile", "os.WriteFile", "os.Open", "os.Create", "os.Remove", "os.MkdirAll", "os.Stat", "os.Mkdir", "os.OpenFile", "os.ReadDir")
ENV_CALLS = ("os.Getenv", "os.LookupEnv")
ERROR_CALLS = ("errors.Is", "errors.As", "errors.New")
CLIENT_CALLS = ("http.Get", "http.Post", "http.Do", "http.NewRequest", "client.Do", "client.Get")
JSON_CALLS = ("json.Marshal", "json.Unmarshal", "json.NewEncoder", "json.NewDecoder")
IO_CALLS = ("io.ReadAll", "io.Copy")
#: Types that show a database handle.
DATABASE_TYPES = ("*sql.DB", "*sql.Tx", "sql.DB", "sql.Tx", "*gorm.DB", "gorm.DB", "*sqlx.DB", "*sqlx.Tx", "sqlx.DB", "sqlx.Tx", "*pgx.Conn", "*pgxpool.Pool", "pgx.Conn", "pgxpool.Pool")
#: Web frameworks by import.
FRAMEWORKS = {"net/http": "net/http", "gin": "github.com/gin-gonic/gin", "echo": "github.com/labstack/echo", "fiber": "github.com/gofiber/fiber"}
#: Pattern kinds in the order of detection, with their summaries.
SUMMARIES = {
    "http_handler": "HTTP handler", "context": "Uses context.Context", "time_now": "Uses time.Now()", "env_var": "Reads environment variables", "file_io": "Performs file I/O",
    "database": "Uses a database", "errors_wrap": "Uses error wrapping/inspection", "http_client": "Makes outgoing HTTP requests", "json_encoding": "Uses JSON encoding/decoding",
    "io_readwrite": "Uses io.Reader/Writer or io utilities",
}


def imported(imports: Column, path: str) -> Column:
    return F.exists(imports, lambda i: (i == path) | i.endswith("/" + path))


def code_of(body: Column) -> Column:
    """The body with comments and literals blanked, so that words in them are no syntax."""
    return F.regexp_replace(body, r"//[^\n]*|(?s:/\*.*?\*/)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'", "\"\"")


def any_call(body: Column, calls: tuple[str, ...]) -> Column:
    """Whether the body calls one of these functions of a package."""
    names = "|".join(r"\s*\.\s*".join(c.split(".")) for c in calls)
    return code_of(body).rlike(rf"(?<![\w.])({names})\s*\(")


def framework(params: Column, returns: Column, imports: Column) -> Column:
    """Name of the web framework whose handler a function is, by its first telling parameter, else null."""
    has = {k: imported(imports, p) for k, p in FRAMEWORKS.items()}

    def of(p: Column) -> Column:
        t = p["type"]
        return (F.when(has["net/http"] & t.isin("http.ResponseWriter", "*http.Request"), "net/http").when(has["gin"] & (t == "*gin.Context"), "gin")
                .when(t.contains("echo.Context"), "echo").when(has["fiber"] & t.contains("fiber.Ctx"), "fiber"))

    by_param = F.get(F.filter(F.transform(params, of), lambda x: x.isNotNull()), 0)
    by_return = F.when(has["net/http"] & F.exists(returns, lambda r: r.isin("http.Handler", "http.HandlerFunc")), "net/http")
    return F.coalesce(by_param, by_return)


def detect(functions: DataFrame, imports: Column, receiver_fields: Column | None = None) -> DataFrame:
    """functions with `kinds`, pattern kinds in their fixed order, and `hints`, struct(kind, summary) of each.

    imports: array of import paths; receiver_fields: array of field types of the receiver's struct, if known.
    """
    body, params = F.col("body"), F.col("params")
    has_param = lambda *types: F.exists(params, lambda p: p["type"].isin(*types))
    fields = receiver_fields if receiver_fields is not None else F.expr("cast(array() as array<string>)")
    tests = {
        "http_handler": framework(params, F.col("returns"), imports).isNotNull(),
        "context": has_param("context.Context"), "time_now": any_call(body, ("time.Now",)), "env_var": any_call(body, ENV_CALLS), "file_io": any_call(body, FILE_CALLS),
        "database": has_param(*DATABASE_TYPES) | F.arrays_overlap(F.coalesce(fields, F.array()), F.array(*map(F.lit, DATABASE_TYPES))),
        "errors_wrap": any_call(body, ERROR_CALLS) | (any_call(body, ("fmt.Errorf",)) & body.contains("%w")),
        "http_client": imported(imports, "net/http") & any_call(body, CLIENT_CALLS), "json_encoding": imported(imports, "encoding/json") & any_call(body, JSON_CALLS),
        "io_readwrite": imported(imports, "io") & (any_call(body, IO_CALLS) | has_param("io.Reader", "io.Writer")),
    }
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]))
    names = F.create_map(*[F.lit(x) for kv in SUMMARIES.items() for x in kv])
    return functions.withColumn("kinds", kinds).withColumn("hints", F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.element_at(names, k).alias("summary"))))


def context_use(body: Column) -> Column:
    """struct(cancel, value): whether a context's end or values are looked at."""
    cancel = body.contains("ctx.Done()") | body.contains("ctx.Err()") | body.contains("ctx.Deadline()")
    return F.struct(cancel.alias("cancel"), body.contains("ctx.Value(").alias("value"))


def needs_care(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(F.lit("json_encoding"), F.lit("database")))


# --- concurrency -------------------------------------------------------------------------------------------------------


#: Names of concurrency primitives in reports, those of text only, and what precedes an atomic function's name.
PRIMITIVES = ("goroutine launch (go statement)", "channel type", "channel send", "channel receive", "channel creation (make)", "sync.Mutex", "sync.RWMutex", "sync.WaitGroup", "sync.Once",
              "channel parameter/return", "struct field: channel")
TEXT_MATCHES, ATOMIC = ("sync.Mutex (text match)", "sync.WaitGroup (text match)", "sync.Once (text match)", "sync/atomic (text match)"), "sync/atomic."


def concurrency(functions: DataFrame, receiver_fields: Column | None = None) -> DataFrame:
    """functions with `concurrency`: flags and the ordered distinct patterns behind them."""
    code, body = code_of(F.col("body")), F.coalesce("body", F.lit(""))
    fields = F.coalesce(receiver_fields if receiver_fields is not None else F.lit(None).cast("array<string>"), F.expr("cast(array() as array<string>)"))
    types = F.concat(F.transform("params", lambda p: p["type"]), F.col("returns"))
    some = lambda needle: F.exists(fields, lambda f: f.contains(needle))
    typed_channel = F.exists(types, lambda t: t.rlike(r"^(chan |<-chan|chan<-|chan$)"))
    field_channel = F.exists(fields, lambda f: f.rlike(r"^chan( |$)"))
    go, chan = code.rlike(r"(?m)(^|[;{}\s])go\s+[\w(]"), code.rlike(r"\bchan\b")
    send = code.rlike(r"(?<![\w.])(?!(?:return|case|range|chan|go|defer)\b)[\p{L}_]\w*(?:\.\w+|\[[^\]]*\]|\([^()]*\))*\s*<-\s*(?!chan\b)\S")
    receive = code.rlike(r"(?m)(?:^|[-=(,:;{&|!+*/<>]|\b(?:return|case|range|go|defer))\s*<-\s*(?!chan\b)[\w(]")
    made = code.rlike(r"\bmake\(\s*(<-)?chan\b")
    used = {k: code.rlike(rf"(?<![\w.])sync\.{k}\b") for k in ("Mutex", "RWMutex", "WaitGroup", "Once")}
    atomics = F.transform(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?<![\w.])atomic\.(\w+)"), F.lit(1))), lambda n: F.concat(F.lit(ATOMIC), n))
    atomic = F.size(atomics) > 0
    found = dict(zip(PRIMITIVES, (go, chan, send, receive, made, *used.values(), typed_channel, field_channel)))
    listed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))
    by_field = F.transform(F.filter(fields, lambda f: f.rlike("Mutex|WaitGroup|Once")), lambda f: F.concat(F.lit("struct field: "), f))
    # what only comments or strings name is told apart
    texts = dict(zip(TEXT_MATCHES, (~used["Mutex"] & ~used["RWMutex"] & body.rlike(r"sync\.(RW)?Mutex"), ~used["WaitGroup"] & body.contains("sync.WaitGroup"), ~used["Once"] & body.contains("sync.Once"), ~atomic & body.contains("atomic."))))
    by_text = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in texts.items()]))
    flags = {
        "has_goroutines": go, "has_channels": chan | send | receive | made | typed_channel | field_channel, "has_mutex": body.rlike(r"sync\.(RW)?Mutex") | some("Mutex"),
        "has_wait_group": body.contains("sync.WaitGroup") | some("WaitGroup"), "has_once": body.contains("sync.Once") | some("Once"), "has_atomic": body.contains("atomic."),
    }
    concurrent = F.lit(False)
    for c in flags.values():
        concurrent = concurrent | c
    return functions.withColumn("concurrency", F.struct(concurrent.alias("is_concurrent"), *[c.alias(k) for k, c in flags.items()], F.array_distinct(F.concat(listed, atomics, by_text, by_field)).alias("patterns")))


def concurrency_hint(info: Column) -> Column:
    """Advice for tests of concurrent functions, empty for others."""
    lines = F.array_join(F.transform(info["patterns"], lambda p: F.concat(F.lit("  - "), p, F.lit("\n"))), "")
    advice = "\nTest it from many goroutines at once too: wait for all of them, then check the final state; end such tests' names with _Concurrent.\n"
    more = F.concat(F.when(info["has_channels"], "Channels: send, receive, close, select with a timeout.\n").otherwise(""), F.when(info["has_mutex"], "Locks: reads and writes at once stay consistent.\n").otherwise(""))
    return F.when(info["is_concurrent"], F.concat(F.lit("Concurrency in use:\n"), lines, F.lit(advice), more)).otherwise("")


# --- branches as text, prompt budget -----------------------------------------------------------------------------------


def branch_lines(body: Column) -> Column:
    """Descriptions of the branches that single lines of a body show, for bodies that can't be parsed (see gosource.branch_texts)."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    quoted = lambda name, x, start, end: F.concat(F.lit(f"{name}: `"), F.regexp_replace(F.regexp_replace(x, start, ""), end, ""), F.lit("`"))

    def tell(x: Column) -> Column:
        return (F.when(x.startswith("if "), quoted("Condition", x, "^if ", r" \{$")).when(x.startswith("} else if "), quoted("Else-if", x, r"^\} else if ", r" \{$")).when(x == "} else {", "Else branch")
                .when(x.startswith("switch "), "Switch statement").when(x.startswith("case "), quoted("Case", x, "^case ", ":$")).when(x.contains("err != nil"), "Error check (err != nil)"))

    return F.array_compact(F.transform(lines, tell))


def enforce_budget(requests: DataFrame, max_tokens: int = 32_000, overhead: int = 900, reserve: int = 4_000, body_lines: int = 60, callees: int = 5, names: int = 20) -> DataFrame:
    """Requests (prompt, bodies, callees, test_names) over budget get shorter bodies, fewer callees and test names."""
    from ..functions.scalars import estimate_tokens, truncate_body

    over = (estimate_tokens(F.col("prompt")) > max_tokens - overhead - reserve) if max_tokens > overhead + reserve else F.lit(False)
    out = requests.withColumn("truncated", over)
    return (out.withColumn("bodies", F.when(over, F.transform("bodies", lambda b: truncate_body(b, body_lines))).otherwise(F.col("bodies")))
            .withColumn("callees", F.when(over, F.slice("callees", 1, callees)).otherwise(F.col("callees")))
            .withColumn("test_names", F.when(over, F.slice("test_names", 1, names)).otherwise(F.col("test_names"))))
