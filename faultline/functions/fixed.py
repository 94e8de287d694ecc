"""Results depend on them being exactly these."""

# ---- fixed values: text that marks a log line as an error (compared in lower case, in this order) ----
ERROR_PATTERNS = (
    "make: ***",
    "Sending interrupt signal to process",
    "killed by signal",
    "git clone failed",
    "err!",
    "subprocess.calledprocesserror: command",
    "unknown: bad credentials",
    "npm err! ebusy: resource busy",
    "build-packetlogic2/packages/buildenv/11_llvm:",
    "docker.errors",
    "exception:",
    "traceback",
    "could not resolve",
    "compilation error",
    "build failed",
    "baseline.tar.lzma: unexpected end of input",
    "error: ",
)

# ---- fixed values: text that takes a line out again ----
IGNORE_PATTERNS = (
    "error: tag ",
    "[ FAIL ]",
    "[new branch]",
    "INFO: I/O exception",
    "-exception-",
)

# ---- fixed values: context sizes, caps, markers ----
LINES_BEFORE = 50
LINES_AFTER = 10
CONTEXT_BUCKETS = ((50, 50, 10), (100, 10, 5), (150, 5, 2))  # (errors, lines before, lines after)
MAX_LINE_LENGTH = 1000
TAIL_LINES = 5000
HEAD_LINES = 100000
BYTES_PER_LINE = 150
CHUNK_CHARS = 2500
OVERVIEW_CHARS = 6000
SECTION_SEPARATOR = "--- Next Error Section ---"
EMPTY_FIX = "(empty fix)"
MAIL_DOMAIN = "@internal.com"
SYSTEM_USER = "jenkins"
FIX_SIMILARITY = 0.78
DOMAIN_SIMILARITY = 0.55
TOP_K = 5
CACHE_HOURS = 24

# ---- fixed values: statuses and event kinds ----
MAIN_SOURCES = ("push", "web", "schedule", "trigger", "api")
CHILD_SOURCE = "parent_pipeline"
UNFINISHED_STATUSES = ("running", "pending", "created")
FAILED_STAGE_STATUSES = ("FAILED", "FAILURE")
CONTINUED_STATUSES = ("SUCCESS", "SKIPPED")
PIPELINE_HOOK = "Pipeline Hook"
PARAMETERS_ACTION = "hudson.model.ParametersAction"
CAUSE_ACTION = "hudson.model.CauseAction"
USER_CAUSE = "hudson.model.Cause$UserIdCause"

# ---- fixed values: secret patterns, (prefix)(value), first match decides; and a lower-case text each one needs ----
SECRET_MARKS = ("glpat-", "gldt-", "token", "secret", "authorization:", "private-token:")
SECRET_PATTERNS = (
    r"(glpat-)([a-zA-Z0-9_-]{20,})",
    r"(gldt-)([a-zA-Z0-9_-]{20,})",
    r"(?i)(token[=:]\s*)([^\s&]+)",
    r"(?i)(secret[=:]\s*)([^\s&]+)",
    r"(?i)(Authorization:\s+(?:Bearer\s+)?)([^\s]+)",
    r"(?i)(PRIVATE-TOKEN:\s*)([^\s]+)",
)
SECRET_KEYS = ("token", "secret", "password", "auth")
REDACTED = "...[REDACTED***]"

# ---- fixed values: symbols taken out of text, each with its trailing space ----
REMOVED_SYMBOLS = (
    "📊 ", "📈 ", "🔀 ", "🎯 ", "🏗️ ", "✨ ", "📁 ", "🔄 ", "🎉 ", "🚫 ", "📚 ",
    "🚀 ", "🐳 ", "⚙️ ", "📖 ", "📡 ", "🧪 ", "📝 ", "🤝 ", "📄 ", "📋 ", "🔧 ",
)
# ---- fixed values: symbols replaced by plainer ones ----
REPLACED_SYMBOLS = (("✅ ", "✓ "), ("❌ ", "✗ "), ("⚠️ ", "! "), ("❓ ", "? "))

# ---- fixed values: keys of a fix import row that are not metadata ----
FIX_BASE_FIELDS = ("error_text", "error", "fix_text", "fix", "approver", "approved_by", "status")

# ---- fixed values: texts shown to readers ----
NO_LOG_TEXT = "[Log not available for job {}]"
LOG_ERROR_TEXT = "[Error fetching log: {}]"
NO_STAGE_TEXT = "Stage '{}' failed but no log content available"
UNSCORED_TEXT = (
    "MR analysis could not be scored because the input payload was not compatible with "
    "RateMyMR evaluation. This is likely an upstream integration issue."
)
NO_FINDINGS_TEXT = "_No major vulnerabilities found._"
NO_ADVICE_TEXT = "_No recommendations provided._"
SYSTEM_PROMPT = (
    "You are an expert CI/CD build failure resolver for an enterprise GitLab/Jenkins environment.",
    "You receive pipeline metadata, raw error logs, and optional domain knowledge snippets.",
    "Your job is to produce a short, actionable markdown response with sections:",
    "1. Summary (1–3 sentences)",
    "2. Steps (bullet list of concrete actions)",
    "3. Code Fix (only if code change is clearly needed, otherwise say 'N/A')",
    "4. Quick Checks (simple validations the engineer can perform)",
    "",
    "If domain knowledge is provided below, you MUST consider it first and adapt it to the current error.",
)
