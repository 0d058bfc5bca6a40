"""Categories of work: from touched files, tools and commands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shell

CATEGORIES = ("spec", "plan", "research", "code", "tests", "git", "grep", "web", "agents", "prompt", "compaction", "overhead", "interrupted", "other")

# Patterns of command heads, in the order in which they are tried, and the order in which a turn's findings win.
COMMANDS = (
    ("agents", shell.SPAWN),
    ("spec", r"^gh\s+issue\s+(?:view|comment|create|edit|reopen|develop)(?:\s|$)"),
    ("grep", r"^gh\s+(?:api\s+graphql|search)(?:\s|$)"),
    ("git", r"^(?:git|gh|tig|hub|glab|pr-(?:open|submit|ready|watch|threads|cleanup|merge|reject|review|verdict|guard)|git-(?:checkpoint|overview|snap)|wt-new|repo-gate)(?:\s|$)"),
    ("tests", r"^(?:(?:bun|npm|pnpm|yarn|deno)\s+(?:run\s+)?test\b|(?:bun|npx)\s+\S*tests?/|(?:pytest|jest|vitest|mocha|ava|tap|cypress|playwright|ctest)\b|(?:go|cargo)\s+test\b"
              r"|(?:bash|sh|zsh)\s+\S*tests?/|\.?/?tests?/\S+\.(?:sh|ts|js|mjs|py)\b)"),
    ("code", r"^(?:(?:bun|npm|pnpm|yarn|deno)\s+run\s+(?:build|typecheck|lint|check|compile|bundle)\b|bun\s+build\S*"
             r"|(?:tsc|esbuild|webpack|vite|rollup|make|cmake|ninja|gcc|g\+\+|clang|eslint|prettier|ruff|black|clippy|shellcheck)\b|(?:go|cargo)\s+(?:build|install)\b)"),
    ("grep", r"^(?:grep|rg|ripgrep|find|fd|ag|ack)(?:\s|$)"),
)
COMMAND_ORDER = ("agents", "spec", "git", "tests", "code", "grep")
TOOL_ORDER = ("agents", "web", "git", "plan", "grep")
FILE_ORDER = ("tests", "code", "research", "spec", "plan")
# Category of a tool by its lower-case name.
TOOLS = {
    "task": "agents", "agent": "agents", "workflow": "agents", "taskoutput": "agents", "taskstop": "agents", "sendmessage": "agents", "listagents": "agents", "monitor": "agents",
    "websearch": "web", "webfetch": "web", "search_web": "web", "web_search": "web", "fetch_url": "web",
    "enterworktree": "git", "exitworktree": "git",
    "grep": "grep", "glob": "grep", "find": "grep", "search_files": "grep",
    "todowrite": "plan", "todo_write": "plan", "taskcreate": "plan", "taskupdate": "plan", "taskget": "plan", "tasklist": "plan", "askuserquestion": "plan", "ask": "plan",
    "enterplanmode": "plan", "exitplanmode": "plan", "skill": "plan", "toolsearch": "plan", "sendfeedback": "plan",
}
# Tools that are calls but no work, and names of outside tools that search or fetch.
IDLE_TOOLS = ("change_working_directory", "cd", "pwd", "lsdir", "listmcpresourcestool")
OUTSIDE_WEB = r"^mcp__.*?__(?:.*_)?(?:web_)?(?:search|fetch|browse|crawl)(?:_|$)"
SUFFIXES = r"(?i)\.(ts|js|mjs|json|jsonl|css|tsx|jsx|py|rs|go|sh|yml|yaml|sql|txt)$"


def command_class(command: Column) -> Column:
    """The first fitting family of a command's first line, null if none fits."""
    return shell.bound(F.lower(F.substring_index(command, "\n", 1)), lambda head: F.coalesce(*[F.when(head.rlike(p), F.lit(c)) for c, p in COMMANDS]))


def tool_class(name: Column) -> Column:
    """Category of a tool by its lower-case name, null if it has none."""
    kinds = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, name), F.when(name.rlike(OUTSIDE_WEB), F.lit("web")))


def tool_known(name: Column) -> Column:
    """Whether a tool has a category or is known to be no work."""
    return tool_class(name).isNotNull() | name.isin(*IDLE_TOOLS)


def path_class(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    below = lambda *dirs: reduce(lambda a, b: a | b, [F.startswith(p, F.lit(f"{d}/")) | F.contains(p, F.lit(f"/{d}/")) for d in dirs])
    name = F.substring_index(p, "/", -1)
    markdown = F.lower(name).rlike(r".\.md$")
    return (
        F.when(F.contains(p, F.lit("node_modules/")), F.when(markdown | F.contains(p, F.lit("/docs/")), "research").otherwise("code"))
        .when(below("docs/research"), "plan")
        .when(below("docs") | markdown, "spec")
        .when(below("tests"), "tests").when(below("research"), "research")
        .when(below(".pi/extensions", "extensions", "src", "public", "bin", "debug"), "code")
        .when(name.rlike(SUFFIXES) | name.rlike(r"\.(gitignore|dockerignore)$") | ~name.rlike(r".\.[^.]*$"), "code")
    )


def first_of(order, found: Column) -> Column:
    """The first category of ``order`` among an array of them."""
    return shell.bound(found, lambda known: F.coalesce(*[F.when(F.array_contains(known, c), F.lit(c)) for c in order]))


def files_class(files: Column) -> Column:
    """From (path, action) pairs: writes before reads, later stages of work before earlier ones."""
    by = lambda action: F.transform(F.filter(files, lambda f: f["action"] == action), lambda f: path_class(f["path"]))
    return F.coalesce(first_of(FILE_ORDER, by("write")), first_of(FILE_ORDER, by("read")))


def commands_class(commands: Column) -> Column:
    """Category of a turn's commands as given: of their real commands the first in COMMAND_ORDER, other without a family, null if none does work."""
    return shell.bound(shell.all_real_commands(commands), real_class)


def real_class(real: Column) -> Column:
    """Category of real commands."""
    return F.coalesce(first_of(COMMAND_ORDER, F.transform(real, command_class)), F.when(F.size(real) > 0, F.lit("other")))


def turn_class(interrupted: Column, files: Column, tools: Column, commands: Column, has_text: Column, unknown_tool: Column) -> Column:
    """Category of a turn; ``commands`` are as given to the shell, ``tools`` its tools' categories."""
    return F.coalesce(
        F.when(interrupted, F.lit("interrupted")), files_class(files), first_of(TOOL_ORDER, tools), commands_class(commands),
        F.when(has_text & ~unknown_tool, F.lit("prompt")), F.lit("other"))


def decided_by(interrupted: Column, files: Column, tools: Column, commands: Column, has_text: Column, unknown_tool: Column) -> Column:
    """Which input decided a turn's category."""
    return (F.when(interrupted, "interrupt").when(files_class(files).isNotNull(), "files").when(first_of(TOOL_ORDER, tools).isNotNull(), "tools")
            .when(commands_class(commands).isNotNull(), "commands").when(has_text & ~unknown_tool, "text").otherwise("nothing"))
