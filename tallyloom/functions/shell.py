"""Shell commands taken apart by column expressions: segments, real commands, words, touched files, working directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators between commands; what may stand before a command; what is grammar, a definition, navigation or a wait.
SEPARATORS = ("&&", "||", "|&", ";;", ";", "|", "\n")
WRAPPERS = (
    r"timeout(?:\s+(?:-k|--kill-after|-s|--signal)(?:=\S+|\s+\S+)|\s+(?:--preserve-status|--foreground|-[a-zA-Z]\S*))*\s+\S+",
    r"time(?:\s+(?:-o|--output|-f|--format)(?:=\S+|\s+\S+)|\s+-[a-zA-Z]\S*)*",
    r"nice(?:\s+(?:-n|--adjustment)(?:=\S+|\s+-?\d+)|\s+-\d+)?",
    r"ionice(?:\s+(?:-c|-n|-p)(?:=\S+|\s+\S+)|\s+-[a-zA-Z]\S*)*",
    r"nohup",
    r"stdbuf(?:\s+(?:-i|-o|-e)(?:=\S+|\s+\S+))*",
    r"command",
    r"builtin",
    r"exec",
    r"sudo(?:\s+(?:-u|-g|-U|-p|-C|-D|-h|--user|--group|--prompt)(?:=\S+|\s+\S+)|\s+-[a-zA-Z]\S*)*",
    r"doas(?:\s+-u\s+\S+|\s+-[a-zA-Z]\S*)*",
    r"""env(?:\s+(?:-u|--unset)(?:=\S+|\s+[A-Za-z_]\w*)|\s+-[A-Za-z]+|\s+[A-Za-z_]\w*=(?:"[^"]*"|'[^']*'|\S*))*""",
    r"xargs(?:\s+(?:-I|-i|-n|-P|-d|-a|-E|-s|--replace|--max-args|--max-procs|--delimiter)(?:=\S+|\s+\S+)|\s+-[a-zA-Z]\S*)*",
    r"script\s+-qc",
)
ASSIGNMENT = r"""[A-Za-z_]\w*=(?:"(?:[^"\\]|\\.)*"|'[^']*'|\$\((?:[^()]|\([^()]*\))*\)|`[^`]*`|[^\s;&|]*)(?:[ \t]+|$)"""
OPENERS = r"(?:do|then|else|!)\s+|\{\s+|\(\s*"
DECLARATIONS = r"(?:export|declare|local|readonly|typeset|set)\s+"
KEYWORD = r"^(?:for|while|until|if|elif|else|then|do|done|fi|case|esac|in|select|function|coproc|\}|\(|\)|!)(?:\s|$)"
FUNCTION = r"^(?:[A-Za-z_][\w-]*\s*\(\s*\)|function\s+[A-Za-z_][\w-]*)"
NAVIGATION = r"^(?:cd|pushd|popd|dirs|\[|\[\[|test|:|true|false)(?:\s|$)"
WAIT = r"^(?:sleep|wait|usleep)(?:\s|$)"
SPAWN = r"(?:^|\s)claude(?:\s+-|\s*\||\s*$)"
SPAWN_HEAD = r"^claude(?:\s+-|\s*\||\s*$)"
# Commands that read files, whose first argument is a program, that edit in place, that run an inline script; paths that count and that do not.
READER = r"^(?:sed|cat|head|tail|less|more|bat|nl|od|xxd|strings|wc|awk|cut|diff|jq|yq|pdftotext)(?:\s|$)"
PROGRAM_FIRST = r"^(?:sed|awk|gawk|nawk|perl|jq|yq)(?:\s|$)"
EDITOR = r"^(?:sed\s+(?:-\S*\s+)*(?:-i\S*|--in-place(?:=\S+)?)|perl\s+(?:-\S+\s+)*-i\S*|tee)(?:\s|$)"
SCRIPT = r"^(?:python3?|node|bun|deno|perl|ruby|php|osascript)\s+(?:-\s*(?:$|<)|-\s|-c(?:\s|$)|-e(?:\s|$))"
SCRIPT_WRITES = (r"""\bopen\s*\(\s*["']([^"']+)["']\s*,\s*["'][wa]""", r"""\bwriteFileSync\s*\(\s*["']([^"']+)["']""", r"""\bPath\s*\(\s*["']([^"']+)["']\s*\)\s*\.write""")
SCRIPT_READS = (r"""\bopen\s*\(\s*["']([^"']+)["']""", r"""\breadFileSync\s*\(\s*["']([^"']+)["']""", r"""\bloadtxt\s*\(\s*["']([^"']+)["']""")
SYSTEM_PATH = r"^/(?:dev|proc|sys|run|tmp|etc|var|boot|lib|sbin|opt)(?:/|$)"
PATH = r"^(?:~|\.\.?)?/?[A-Za-z0-9_.@+][A-Za-z0-9_.@+/-]*$"

PREFIX = "^(?:" + "|".join([OPENERS, DECLARATIONS, ASSIGNMENT, "(?:" + "|".join(WRAPPERS) + r")\s+"]) + ")+"
#: A here-document; its body is moved next to the operator that opens it, before the rest of that line.
HEREDOC = r"""(?s)(<<-?[ \t]*(['"]?)([A-Za-z_]\w*)\2)([^\n]*)(\n(?:.*?\n)??[ \t]*\3)(?=\n|\z)"""
#: What a shell reads as one: quoted, substituted and escaped text, a here-document, a comment, an operator, or plain text.
LEXEME = (
    r"""(?s)'[^']*(?:'|\z)|"(?:\\.|[^"\\])*(?:"|\z)|`(?:\\.|[^`\\])*(?:`|\z)|\$\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|<<-?[ \t]*(['"]?)([A-Za-z_]\w*)\1\n(?:.*?\n)??[ \t]*\2(?=\n|\z|\x03)"""
    r"""|\\.|(?<![^\s;&|(])#[^\n]*|&&|\|\||\|&|;;|[;|\n]|(?:[^'"`$\\#&|;\n<]|<(?!<))+|.""")
#: Words and redirections of a line.
WORD = r"""<<<\s*(?:'[^']*'|"[^"]*"|\S+)|<<-?\s*(?:'[^']*'|"[^"]*"|\w+)|\d?(?:>>?|<)(?:&[\d-]*)?|(?:\\.|'[^']*'?|"(?:\\.|[^"\\])*"?|[^\s<>'"\\])+"""
_OPEN, _CLOSE, _MOVED = "\x01", "\x02", "\x03"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there: lambdas work out anew what they name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _clean(command: Column) -> Column:
    return F.translate(command, _OPEN + _CLOSE + _MOVED, "")


def segments(command: Column) -> Column:
    """The commands that a shell would run, as (text, joined_by): operators inside quotes, substitutions and here-documents do not divide."""
    tokens = F.regexp_extract_all(F.regexp_replace(_clean(command), HEREDOC, f"$1$5{_MOVED}$4"), F.lit(LEXEME), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.isin(*SEPARATORS), F.concat(F.lit(_OPEN), t, F.lit(_CLOSE))).when(t == "\\\n", " ").when(F.startswith(t, F.lit("#")) | (t == _MOVED), "").otherwise(t))
    parts = F.split(F.concat(F.lit(_CLOSE), F.array_join(marked, "")), _OPEN)
    found = F.transform(parts, lambda p: F.struct(trimmed(F.replace(F.substring_index(p, _CLOSE, -1), F.lit(_MOVED), F.lit(""))).alias("text"), F.substring_index(p, _CLOSE, 1).alias("joined_by")))
    return F.filter(found, lambda s: s["text"] != "")


def bare(segment: Column) -> Column:
    """A segment without assignments, declarations, openers of a body and wrappers before its command."""
    return trimmed(F.regexp_replace(trimmed(segment), PREFIX, ""))


def braces(segment: Column) -> Column:
    """Opening less closing braces outside quotes."""
    plain = F.regexp_replace(segment, r"""(?s)\\.|'[^']*'?|"(?:\\.|[^"\\])*"?""", "")
    return (F.regexp_count(plain, F.lit(r"\{")) - F.regexp_count(plain, F.lit(r"\}"))).cast("int")


def real_commands(command: Column) -> Column:
    """The commands that do work, in order: no grammar, navigation, bodies of functions, or waits inside a loop."""
    start = F.struct(F.lit(0).alias("loop"), F.lit(0).alias("body"), F.array().cast("array<string>").alias("out"))

    def step(at, s):
        text, own = s["text"], s["own"]
        defines, inside = own.rlike(FUNCTION), at["body"] > 0
        loop = at["loop"] + F.when(text.rlike(r"^do(?:\s|$)"), 1).otherwise(0)
        works = (own != "") & ~own.rlike(KEYWORD) & ~own.rlike(NAVIGATION) & ~((loop > 0) & own.rlike(WAIT))
        after = F.when(inside | defines, at["loop"]).when(text.rlike(r"^done\b"), F.greatest(loop - 1, F.lit(0))).otherwise(loop)
        return F.struct(
            after.cast("int").alias("loop"), F.when(inside, at["body"] + braces(text)).when(defines, F.greatest(braces(text), F.lit(0))).otherwise(0).cast("int").alias("body"),
            F.when(~inside & ~defines & works, F.concat(at["out"], F.array(own))).otherwise(at["out"]).alias("out"))

    stripped = F.transform(segments(command), lambda s: F.struct(s["text"], bare(s["text"]).alias("own")))
    return F.aggregate(stripped, start, step, lambda at: at["out"])


def all_real_commands(commands: Column) -> Column:
    return F.flatten(F.transform(commands, real_commands))


def primary_command(command: Column) -> Column:
    """The first real command, empty without one."""
    return F.coalesce(F.get(real_commands(command), F.lit(0)), F.lit(""))


def unquoted(word: Column) -> Column:
    return F.regexp_replace(word, r"""'([^']*)'?|"((?:\\.|[^"\\])*)"?|\\(.)""", "$1$2$3")


def words(command: Column) -> Column:
    """(word, role) of a command's first line: role is word, write or read; here-documents and descriptors have none."""
    redirects = lambda t: t.rlike(r"^\d?(?:>>?|<)$")

    def roles(tokens):
        before = F.concat(F.array(F.lit("")), tokens)
        role = lambda b: F.when(redirects(b), F.when(F.contains(b, F.lit(">")), "write").otherwise("read")).otherwise("word")
        one = lambda t, b: F.struct(unquoted(t).alias("word"), F.when(~t.rlike(r"^(?:<<|\d?[<>])"), role(b)).alias("role"))
        return F.zip_with(tokens, F.slice(before, F.lit(1), F.size(tokens)), one)

    return F.filter(bound(F.regexp_extract_all(first_line(command), F.lit(WORD), F.lit(0)), roles), lambda w: w["role"].isNotNull())


def _named(found: Column, role: str) -> Column:
    return F.transform(F.filter(found, lambda w: w["role"] == role), lambda w: w["word"])


def _counts(path: Column) -> Column:
    return (path != "") & ~path.rlike(SYSTEM_PATH) & path.rlike(PATH)


def _touches(paths: Column, action) -> Column:
    return F.transform(F.filter(paths, _counts), lambda p: F.struct(p.alias("path"), (F.lit(action) if isinstance(action, str) else action).alias("action")))


def files_of(command: Column) -> Column:
    """(path, action) that one real command touches: redirections, arguments of readers and editors, calls in inline scripts."""
    nothing = F.array().cast("array<struct<path:string,action:string>>")

    def plain(found):
        written, read, edits = found["written"], found["read"], found["edits"]
        flagless = F.filter(F.slice(found["words"], 2, 1 << 20), lambda w: ~F.startswith(w, F.lit("-")))
        arguments = F.filter(F.slice(flagless, F.when(command.rlike(PROGRAM_FIRST), 2).otherwise(1), F.lit(1 << 20)), lambda w: ~w.rlike(r"^\d+$") & ~F.array_contains(written, w))
        given = F.concat(_touches(F.filter(read, lambda p: ~F.array_contains(written, p)), "read"), _touches(arguments, F.when(edits, "write").otherwise("read")))
        return F.concat(_touches(written, "write"), F.when(edits | command.rlike(READER), given).otherwise(nothing))

    named = lambda all_: F.struct(_named(all_, "write").alias("written"), _named(all_, "read").alias("read"), _named(all_, "word").alias("words"), command.rlike(EDITOR).alias("edits"))
    every = lambda patterns: F.concat(*[F.regexp_extract_all(command, F.lit(p), F.lit(1)) for p in patterns])
    script = bound(every(SCRIPT_WRITES), lambda made: F.concat(_touches(made, "write"), _touches(F.filter(every(SCRIPT_READS), lambda p: ~F.array_contains(made, p)), "read")))
    return F.when(command.rlike(SCRIPT), script).otherwise(bound(bound(words(command), named), plain))


def real_files(real: Column) -> Column:
    """(path, action) over real commands."""
    return F.flatten(F.transform(real, files_of))


def all_files(commands: Column) -> Column:
    """(path, action) over the real commands of all ``commands``."""
    return real_files(all_real_commands(commands))


def spawns_agent(command: Column) -> Column:
    """Whether the head line of any real command starts an agent."""
    return F.exists(real_commands(command), lambda c: F.lower(first_line(c)).rlike(SPAWN))


def spawn_directories(command: Column, own: Column) -> Column:
    """The directory of each agent that a command starts, in order; null where the shell's is not known.

    A ``cd`` moves what follows it; one to the right of an or-operator is a fallback, and
    the first stays; a target to be expanded keeps the one before; a bare ``cd`` is unknown.
    ``own`` stands in where no ``cd`` came before and the segment itself runs the agent.
    """
    start = F.struct(F.lit(None).cast("string").alias("at"), F.lit(False).alias("moved"), F.lit(False).alias("kept"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        head, spawns = s["head"], s["spawns"]
        target = F.coalesce(*[F.nullif(F.regexp_extract(head, r"""^cd\s+(?:"([^"]*)"|'([^']*)'|([^\s;&|]+))""", i), F.lit("")) for i in (1, 2, 3)])
        home, moves = head.rlike(r"^cd\s*$"), head.rlike(r"^cd\s+\S")
        skipped = moves & (s["joined_by"] == "||") & a["kept"]
        named = moves & ~skipped & target.isNotNull() & ~target.rlike(r"[$`]")
        place = F.coalesce(a["at"], F.when(~a["moved"] & F.lower(head).rlike(SPAWN_HEAD), own))
        return F.struct(
            F.when(spawns, a["at"]).when(home, F.lit(None)).when(named, target).otherwise(a["at"]).alias("at"),
            F.when(spawns, a["moved"]).otherwise(a["moved"] | home | (moves & ~skipped)).alias("moved"),
            F.when(spawns | home | ~moves, F.lit(False)).otherwise(F.lit(True)).alias("kept"),
            F.when(spawns, F.concat(a["out"], F.array(place))).otherwise(a["out"]).alias("out"))

    names_agent = lambda text: F.contains(F.lower(text), F.lit("claude"))
    parts = F.transform(segments(command), lambda s: F.struct(first_line(bare(s["text"])).alias("head"), (names_agent(s["text"]) & spawns_agent(s["text"])).alias("spawns"), s["joined_by"]))
    # most commands name no agent: they are not taken apart
    return F.when(~names_agent(_clean(command)), F.array().cast("array<string>")).otherwise(F.aggregate(parts, start, step, lambda a: a["out"]))


def all_spawn_directories(commands: Column, own: Column) -> Column:
    """The known directories of the agents that a turn's commands start, each once, in order."""
    found = F.flatten(F.transform(commands, lambda c: spawn_directories(c, own)))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))
