"""Declared schemas of the sources: nothing is inferred."""

QUESTIONS = "id INT, creationdate STRING, title STRING, tags STRING, body STRING"
REPUTATION = "id INT, owneruserid INT, creationdate STRING, reputation DOUBLE"
CYCLOMATIC = "path STRING, file_name STRING, language STRING, function_name STRING, cyclomatic_complexity INT, nloc INT, token_count INT, parameter_count INT, start_line INT, end_line INT"
COGNITIVE = "path STRING, file_name STRING, cognitive_complexity INT"
TAG_SHARES = "cdate DATE, id INT, tag STRING, cnt INT, tot_cnt INT, pct DOUBLE"
GOLDEN = "id INT, question STRING, answer STRING"
ANNOTATORS = "id INT, a_1 STRING, a_2 STRING, a_3 STRING, a_4 STRING"
RESULTS = "ver INT, creationdate STRING, id INT, result_long STRING"
LANGUAGES = "year INT, quarter INT, language STRING, language_type STRING, iso2_code STRING, num_pushers BIGINT"
