"""Call sites of a small program with 27 functions: (caller, true callee, callee by the first-identifier rule)."""

SITES = [
    ("main", "initialize"), ("main", "process"), ("main", "cleanup"),
    ("initialize", "processor_init"), ("initialize", "analyzer_setup"),
    ("process", "processor_run"), ("process", "analyzer_check"),
    ("cleanup", "processor_finalize"), ("cleanup", "analyzer_report"),
    ("error_handler", "format_init"), ("error_handler", "format_escape"), ("error_handler", "validate_content"),
    ("processor_init", "parse_init"), ("processor_init", "format_init"),
    ("processor_run", "parse_token"), ("processor_run", "format_output"),
    ("processor_finalize", "parse_string"), ("processor_finalize", "format_escape"),
    ("analyzer_setup", "parse_init"), ("analyzer_setup", "format_init"),
    ("analyzer_check", "parse_token", "if"), ("analyzer_check", "parse_string"),
    ("analyzer_report", "format_output"), ("analyzer_report", "format_escape"),
    ("parse_init", "buffer_init"),
    ("parse_token", "validate_length", "if"), ("parse_token", "buffer_resize"),
    ("parse_string", "validate_content", "if"), ("parse_string", "str_copy"),
    ("format_init", "buffer_init"),
    ("format_output", "validate_length", "if"), ("format_output", "buffer_resize"),
    ("format_escape", "validate_content", "if"), ("format_escape", "str_equal", "if"),
    ("buffer_init", "max"), ("buffer_init", "malloc"),
    ("buffer_resize", "abs_val"), ("buffer_resize", "min"), ("buffer_resize", "realloc"),
    ("validate_length", "str_len"), ("validate_length", "min"),
    ("validate_content", "str_equal"), ("validate_content", "str_len"),
]

FUNCTIONS = sorted({s[0] for s in SITES} | {"min", "max", "abs_val", "str_len", "str_equal", "str_copy"})


def edges(mode):
    return [(s[0], s[-1] if mode == "compat" else s[1]) for s in SITES]
