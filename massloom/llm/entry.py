"""The corpus queries and their SQL, for the driver's registry."""

from massloom.llm import base_checks
from massloom.llm import op01_sharding as op1
from massloom.llm import op02_quality as op2
from massloom.llm import op03_neardup as op3
from massloom.llm import op04_pieces as op4
from massloom.llm import op05_rules as op5
from massloom.llm import op06_urls as op6
from massloom.llm import op07_toxicity as op7
from massloom.llm import op08_substrings as op8
from massloom.llm import op09_decontaminate as op9
from massloom.llm import op10_secrets as op10
from massloom.llm import op11_conversations as op11
from massloom.llm import op12_lines as op12
from massloom.llm import op13_search as op13

QUERIES = {
    "op1_sharding": op1.op1_sharding,
    "op2_quality": op2.op2_quality,
    "op3_neardup": op3.op3_neardup,
    "op4_pieces": op4.op4_pieces,
    "op5_rules": op5.op5_rules,
    "op6_urls": op6.op6_urls,
    "op7_toxicity": op7.op7_toxicity,
    "op8_substrings": op8.op8_substrings,
    "op9_decontaminate": op9.op9_decontaminate,
    "op10_secrets": op10.op10_secrets,
    "op11_conversations": op11.op11_conversations,
    "op12_lines": op12.op12_lines,
    "op13_search": op13.op13_search,
    **base_checks.QUERIES,
}
ORACLE_SQL = {
    "op3_neardup": op3.ORACLE_SQL,
    "op6_urls": op6.ORACLE_SQL,
    "op8_substrings": op8.ORACLE_SQL,
    "op9_decontaminate": op9.ORACLE_SQL,
    "op11_conversations": op11.ORACLE_SQL,
    "op12_lines": op12.ORACLE_SQL,
    "op13_search": op13.ORACLE_SQL,
    **base_checks.ORACLE_SQL,
}
