"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

#: The metrics of a run that may be missing, in order of presentation.
METRICS = ("diff_cov_pct", "branch_cov_pct", "error_path_cov_pct", "mutation_pct", "token_efficiency", "assertion_ratio",
           "no_assertions_pct", "nil_only_pct", "error_asserts_pct", "test_name_score", "var_name_score")
COUNTERS = ("files_processed", "tests_generated", "tests_validated")

_NATURALNESS = ("struct<test_count:int,assertion_ratio:double,no_assertions_pct:double,duplicate_assertions_pct:double,"
                "nil_only_assertions_pct:double,error_assertions_pct:double,test_name_score:double,var_name_score:double>")
_TOTALS = ("struct<files_processed:int,tests_generated:int,tests_validated:int,tests_cached:int,diff_coverage_pct:double,mutation_score_pct:double,"
           "mutations_killed:int,mutations_total:int,branch_coverage_pct:double,branches_covered:int,branches_total:int,error_path_coverage_pct:double,"
           "error_paths_covered:int,error_paths_total:int,prompt_tokens:bigint,completion_tokens:bigint,token_efficiency_tokens_per_test:double,"
           f"naturalness:{_NATURALNESS}>")
REPORT_FILE = ("struct<file:string,functions:array<string>,status:string,tests_total:int,tests_passed:int,tests_pruned:int,diff_coverage_pct:double,"
               "branch_coverage_pct:double,branches_total:int,branches_covered:int,error_path_coverage_pct:double,error_paths_total:int,error_paths_covered:int,"
               "mutation_score_pct:double,mutation_killed:int,mutation_total:int,prompt_tokens:bigint,completion_tokens:bigint,"
               f"token_efficiency_tokens_per_test:double,naturalness:{_NATURALNESS}>")
_CONFIG = ("struct<coverage_target:double,max_retries:int,max_coverage_iter:int,race_detection:boolean,mutation_enabled:boolean,cache_enabled:boolean,"
           "smart_diff_enabled:boolean,coverage_analysis:boolean,validation_enabled:boolean,timeout_seconds:int,max_context_tokens:int,exclude_files_count:int,"
           "ablation_config:string,types_enabled:boolean,structured_feedback_enabled:boolean,pruning_enabled:boolean,naturalness_enabled:boolean>")
RUN = (f"schema_version string, project_name string, branch string, base_branch string, model string, timestamp timestamp, duration_seconds double, "
       f"totals {_TOTALS}, files array<{REPORT_FILE}>, config {_CONFIG}")
EVENT = "Time timestamp, Action string, Package string, Test string, Elapsed double, Output string"
CACHE = "entries map<string,struct<hash:string,test_file:string,generated_funcs:array<string>,model:string,timestamp:timestamp>>"
DIFF_LINES = "path string, old_path string, hunk int, pos int, type string, content string, old_no int, new_no int"
BLOCKS = "file string, start_line int, start_col int, end_line int, end_col int, num_stmt int, cnt int"
