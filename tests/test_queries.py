"""A sample of registered queries against their SQL at the smallest scale; tests/check_queries.py
runs all of them at sf0.01."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import check_queries as cq  # noqa: E402
from sentrylake.workloads import all_cases  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["cred_bruteforce", "cred_success_after_failures", "exfil_http", "dns_race", "logon_brute", "exec_lnk", "user_backdoor_admin", "pkt_ftp_spray", "pkt_arp_spoof",
         "mail_auth_rules", "lookalike", "parse_vpn", "ids_rules", "stream_exact_window"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    case = next(c for c in all_cases() if c.name == name)
    _, problem = cq.compare(spark, cq.duck(SF), case, SF)
    assert not problem, problem
