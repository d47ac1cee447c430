"""Scalars of the course domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_TOKENS, MEDIUM, HIGH = 120, 1.0, 2.0


def register_number(prefix: Column, batch: Column, number: Column, digits: int = 4) -> Column:
    return F.concat_ws("/", prefix, batch.cast("string"), F.lpad(number.cast("string"), digits, "0"))


def password_problems(word: Column) -> Column:
    """What a password lacks."""
    lacks = [("no upper case", "[A-Z]"), ("no lower case", "[a-z]"), ("no digit", "[0-9]"), ("no sign", "[^A-Za-z0-9]")]
    return F.array_compact(F.array(F.when(F.length(word) < 10, "short"), *(F.when(~word.rlike(p), name) for name, p in lacks)))


def error_line(text: Column) -> Column:
    """The line of the first error that a compiler or interpreter names; null if none does."""
    by_word, by_file = F.regexp_extract(text, r"line ([0-9]+)", 1), F.regexp_extract(text, r"\.[a-z]+:([0-9]+)", 1)
    return F.when(by_word != "", by_word).when(by_file != "", by_file).cast("int")


def error_kind(text: Column) -> Column:
    return F.when(text.contains("error:"), "compile").when(text.rlike("Traceback|panic|Exception"), "runtime")


def matches(printed: Column, expected: Column, how: str) -> Column:
    """Output against what a test expects, line ends and trailing blanks apart."""
    tidy = lambda c: F.rtrim(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), r"(?m)[ \t]+$", ""))
    return tidy(printed) == tidy(expected) if how == "exact" else F.contains(tidy(printed), tidy(expected))


def even_places(total: Column, n: int) -> Column:
    return F.array(*(F.floor(total * (i + 0.5) / n) for i in range(n)))


def curvature(c: Column, tokens: Column) -> tuple[Column, Column, Column]:
    """(status, score, signal): the score is 100 / (1 + e^(-2 (c - HIGH)))."""
    enough = tokens >= LEAST_TOKENS
    score = F.round(100 / (1 + F.exp(-2 * (c - HIGH)))).cast("long")
    return F.when(enough, "ok").otherwise("insufficient_text"), F.when(enough, score), F.when(
        enough, F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")
    )


#: The line of an error in a student's own file, by language; the first pattern that finds one counts. Frames of a language's own
#: library are told apart by FOREIGN.
ERROR_LINES = {
    "ruby": (r"\.rb:(\d+)",),
    "java": (r"(?m)^\S+\.java:(\d+): error", r"(?m)^\s*at [^\s(]+\([^()]*\.java:(\d+)\)"),
    "javascript": (r"/run/\S*?\.js:(\d+)",),
    "c": (r"(?m)^[^\s:]+\.(?:c|cc|cpp|cxx):(\d+):(?:\d+:)? (?:fatal )?error",),
    "php": (r"\bin /run/\S*?\.php on line (\d+)",),
    "go": (r"(?m)^(?:\./)?[^\s:]*\.go:(\d+):(?:\d+:)? ", r"(?m)^\s+/run/\S*?\.go:(\d+)"),
}
#: A frame of a Python trace, and what tells a library's own frames in Java and in Python. The Java one is a look-ahead taken
#: out of its pattern, since the SQL engine's patterns have none.
PYTHON_FRAME, JAVA_FOREIGN, PYTHON_FOREIGN = r'File "[^"]*", line \d+', r"^\s*at (?:java\.|jdk\.|sun\.|javax\.)", r'"[^"]*(?:/usr/|/lib/)[^"]*"'
#: Fixed value: what a C compiler says when it fails.
GCC_FAILURE = r"(?m)^[^\s:]+\.(?:c|cc|cpp|cxx):\d+:(?:\d+:)? (?:fatal )?error|collect2: error|undefined reference to"
#: What tells a program that never started from one that crashed.
NEVER_STARTED = {
    "python": r"(?m)^(?:SyntaxError|IndentationError|TabError)\b", "ruby": "syntax error|SyntaxError", "javascript": r"(?m)^SyntaxError\b",
    "java": r"(?m)^\S+\.java:\d+: error|error: compilation failed", "c": GCC_FAILURE, "cpp": GCC_FAILURE, "php": r"\bParse error\b",
    "go": r"(?m)^(?:# command-line-arguments|(?:\./)?[^\s:]*\.go:\d+:)",
}
ERROR_LINES["cpp"] = ERROR_LINES["c"]


def error_message(stderr: Column, language: Column) -> Column:
    """What a student is told of a failed program: whether it never started or crashed, and the line in their own file where one is known."""

    def first(pattern: str) -> Column:
        found = F.regexp_extract(stderr, pattern, 1)
        if pattern.startswith(r"(?m)^\s*at "):
            frames = F.filter(F.regexp_extract_all(stderr, F.lit(pattern), F.lit(0)), lambda f: ~f.rlike(JAVA_FOREIGN))
            found = F.coalesce(F.regexp_extract(F.get(frames, F.lit(0)), pattern, 1), F.lit(""))
        return F.when(found != "", found)

    frames = F.filter(F.regexp_extract_all(stderr, F.lit(PYTHON_FRAME), F.lit(0)), lambda f: ~f.rlike(PYTHON_FOREIGN))
    python = F.when(F.size(frames) > 0, F.regexp_extract(F.element_at(frames, F.when(F.size(frames) > 0, -1).otherwise(1)), r"line (\d+)", 1))
    line = F.when(F.lit(False), F.lit(None).cast("string"))
    never = F.when(F.lit(False), F.lit(False))
    for name, patterns in ERROR_LINES.items():
        line = line.when(language == name, F.coalesce(*map(first, patterns)))
    for name, pattern in NEVER_STARTED.items():
        never = never.when(language == name, stderr.rlike(pattern))
    kind = F.when(F.coalesce(never.otherwise(False), F.lit(False)), "Compiler error").otherwise("Runtime error")
    line = line.otherwise(python)
    told = F.when(line.isNotNull(), F.concat(kind, F.lit(". Error on line "), line, F.lit("."))).otherwise(F.concat(kind, F.lit(".")))
    return F.when(stderr.rlike("out of memory|OutOfMemoryError"), "The program ran out of memory.").otherwise(told)


def error_message_sql(stderr: str, language: str) -> str:
    q = lambda p: p.replace("'", "''")

    def first(pattern: str) -> str:
        if pattern.startswith(r"(?m)^\s*at "):
            return f"nullif(regexp_extract(list_filter(regexp_extract_all({stderr}, '{q(pattern)}'), lambda f: NOT regexp_matches(f, '{q(JAVA_FOREIGN)}'))[1], '{q(pattern)}', 1), '')"
        return f"nullif(regexp_extract({stderr}, '{q(pattern)}', 1), '')"

    lines = " ".join(f"WHEN '{name}' THEN coalesce({', '.join(map(first, patterns))})" for name, patterns in ERROR_LINES.items())
    python = f"nullif(regexp_extract(list_filter(regexp_extract_all({stderr}, '{q(PYTHON_FRAME)}'), lambda f: NOT regexp_matches(f, '{q(PYTHON_FOREIGN)}'))[-1], 'line (\\d+)', 1), '')"
    never = " ".join(f"WHEN '{name}' THEN regexp_matches({stderr}, '{q(p)}')" for name, p in NEVER_STARTED.items())
    kind, line = f"CASE WHEN coalesce(CASE {language} {never} ELSE false END, false) THEN 'Compiler error' ELSE 'Runtime error' END", f"CASE {language} {lines} ELSE {python} END"
    return f"CASE WHEN regexp_matches({stderr}, 'out of memory|OutOfMemoryError') THEN 'The program ran out of memory.' ELSE {kind} || coalesce('. Error on line ' || {line}, '') || '.' END"


#: Languages in the order in which a file is looked for, and the ending of their files.
ENDINGS = {"python": ".py", "ruby": ".rb", "java": ".java", "javascript": ".js", "c": ".c", "cpp": ".cpp", "php": ".php", "go": ".go"}
#: Stems that name a program's main file.
MAIN_STEMS = ("main", "app", "run", "program", "index")
RUN_OUTPUT = 1000


def answer_file(questions: Column, question: Column, language: Column) -> Column:
    """The name that an answer is saved under: main for a lone question, else q and its number, and the language's ending."""
    ending = F.coalesce(*(F.when(language == k, v) for k, v in ENDINGS.items()))
    return F.concat(F.when(questions == 1, "main").otherwise(F.concat(F.lit("q"), question.cast("string"))), ending)


def main_file(files: Column, preferred: Column) -> tuple[Column, Column]:
    """(file, error) of sorted paths: the preferred path (by its end, else by its name, whatever the case); without one the only runnable
    file, or the only one with a usual stem."""
    wanted = F.lower(F.replace(F.trim(F.coalesce(preferred, F.lit(""))), F.lit("\\"), F.lit("/")))
    name = lambda p: F.lower(F.element_at(F.split(p, "/"), -1))
    by_name = F.filter(files, lambda p: name(p) == name(wanted))
    exact = F.filter(by_name, lambda p: F.lower(p).endswith(wanted))
    runnable = F.filter(files, lambda p: F.lower(p).rlike("(?:" + "|".join(v.replace(".", r"\.") for v in ENDINGS.values()) + ")$"))
    usual = F.filter(runnable, lambda p: F.regexp_replace(name(p), r"\.[^.]*$", "").isin(*MAIN_STEMS))
    found = F.when(
        wanted != "", F.coalesce(F.get(exact, F.lit(0)), F.get(by_name, F.lit(0)))
    ).when(F.size(runnable) == 1, F.get(runnable, F.lit(0))).when(F.size(usual) == 1, F.get(usual, F.lit(0)))
    error = F.when(
        wanted != "", F.concat(F.lit("main file not found: "), wanted)
    ).when(F.size(runnable) == 0, "no runnable file").otherwise("several code files")
    return found, F.when(found.isNull(), error)


def run_output(file: Column, status: Column, code: Column, stdout: Column, stderr: Column) -> Column:
    """A run as a block of text; streams are clipped, empty ones left out."""
    clipped = lambda c: F.when(
        F.length(F.trim(c)) > RUN_OUTPUT, F.concat(F.substring(F.trim(c), 1, RUN_OUTPUT), F.lit("\n... [truncated]"))
    ).otherwise(F.trim(c))
    told = F.when(status == "ok", "ran without errors").when(status == "timeout", "did not finish within the time limit").otherwise(
        F.concat(F.lit("crashed (exit code "), code.cast("string"), F.lit(")"))
    )
    block = lambda name, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{name}:\n"), clipped(c)))
    return F.concat_ws("\n", F.concat(F.lit("--- "), file, F.lit(": "), told, F.lit(" ---")), block("stdout", stdout), block("stderr", stderr))


def utc(text: Column) -> Column:
    """Times as text with or without an offset, as UTC seconds; those without one are UTC."""
    marked = F.when(text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_timestamp(F.to_timestamp(marked))


def registration_open(opened: Column, has_password: Column, ends: Column, now: Column) -> Column:
    """Open to students, with a password, and not ended: the end itself counts as ended, no end as never."""
    return opened & has_password & ~F.coalesce(now >= ends, F.lit(False))


def session_valid(expires: Column, now: Column) -> Column:
    return F.coalesce(expires >= now, F.lit(False))


def chunk_curvature(log_probs: Column, means: Column, variances: Column) -> Column:
    """How far a chunk's tokens lie above what the model expects: the sum of their log probabilities less that of the expected ones, over the
    root of the summed variances (at least a millionth)."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return (add(log_probs) - add(means)) / F.sqrt(F.greatest(add(variances), F.lit(1e-6)))


#: Bounds of a frame difference (of 255): a scene changes above the first; still pictures lie below the second, calm ones below the third.
SCENE, STILL, CALM = 20.0, 5.0, 12.0


def recording_score(average: Column, seconds: Column) -> Column:
    """How likely a video is a still screen recording, of 100."""
    return F.when((average < STILL) & (seconds > 15), 80).when(average < CALM, 50).otherwise(20)
