"""Tunable thresholds and site lists.

The key names and defaults are the public settings of a site profile, so an
existing profile file loads unchanged; keys that no rule reads are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


class _Profile:
    @classmethod
    def from_json(cls, text_or_path: str):
        raw = text_or_path
        if not raw.lstrip().startswith("{"):
            with open(text_or_path, encoding="utf-8") as handle:
                raw = handle.read()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(raw).items() if k in known})


def _lst(*values):
    return field(default_factory=lambda: list(values))


# Default thresholds and allowlists of the network rules.
@dataclass
class NetConfig(_Profile):
    home_nets: list = _lst("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "fe80::/10")
    vpn_pool_nets: list = _lst("10.8.0.0/16")
    known_resolvers: list = _lst("8.8.8.8", "8.8.4.4", "1.1.1.1")
    gateway_ips: list = _lst()
    scanner_allowlist: list = _lst()
    external_scanner_allowlist: list = _lst()
    domain_allowlist: list = _lst(
        "in-addr.arpa", "ip6.arpa", "akamai.net", "akamaiedge.net", "cloudfront.net",
        "azure.com", "windowsupdate.com", "office365.com", "spotify.com",
        "trafficmanager.net", "amazonaws.com", "googleusercontent.com",
        "dropbox.com", "sophosxl.net", "mcafee.com", "avts.mcafee.com",
    )
    upload_destination_allowlist: list = _lst()
    service_accounts: list = _lst()
    business_hours: list = _lst(8, 18)
    vertical_scan_min_ports: int = 10
    vertical_scan_window_s: int = 300
    horizontal_scan_min_hosts: int = 15
    horizontal_scan_window_s: int = 300
    scan_block_ratio: float = 0.60
    ping_sweep_min_hosts: int = 10
    internal_scan_min_ports: int = 5
    internal_scan_min_hosts: int = 5
    bruteforce_min_failures: int = 10
    bruteforce_window_s: int = 600
    spray_min_users: int = 8
    spray_max_attempts_per_user: int = 3
    spray_window_s: int = 3600
    success_after_failures: int = 5
    success_after_window_s: int = 900
    beacon_min_events: int = 8
    beacon_max_jitter: float = 0.35
    beacon_max_mad_ratio: float = 0.25
    beacon_min_period_s: float = 30.0
    beacon_max_period_s: float = 86400.0
    beacon_size_cv_max: float = 0.30
    dns_min_qname_len: int = 60
    dns_min_label_len: int = 30
    dns_min_entropy: float = 3.8
    dns_min_queries_per_domain: int = 50
    dns_min_unique_subdomains: int = 25
    dns_nxdomain_ratio: float = 0.50
    dns_suspicious_qtypes: list = _lst("TXT", "NULL", "CNAME", "MX", "ANY")
    dns_min_hosts_for_campaign: int = 2
    exfil_min_total_bytes: int = 50 * 1024 * 1024
    exfil_out_in_ratio: float = 5.0
    http_post_large_bytes: int = 600
    http_min_posts_to_new_domain: int = 5
    icmp_payload_suspicious_bytes: int = 64
    icmp_min_packets: int = 20
    ftp_stor_min_transfers: int = 3
    lateral_min_targets: int = 3
    lateral_window_s: int = 3600
    arp_min_conflicting_macs: int = 2
    arp_gratuitous_burst: int = 5
    arp_window_s: int = 60
    dns_spoof_ttl_max: int = 60
    dns_spoof_race_window_s: float = 2.0
    max_evidence_lines: int = 10
    min_severity: str = "info"


# Default thresholds and catalogues of the Windows rules.
@dataclass
class WinConfig(_Profile):
    brute_force_window_s: float = 300.0
    brute_force_attempts_threshold: int = 15
    successful_logon_correlation_window_s: float = 3600.0
    external_ip_only: bool = True
    backdoor_privilege_window_s: float = 3600.0
    sensitive_groups: list = _lst("Administrators", "Remote Desktop Users", "Domain Admins",
                                  "Enterprise Admins", "Backup Operators")
    suspicious_persistence_dirs: list = _lst(
        "c:\\temp", "c:\\programdata", "c:\\users\\public", "\\appdata\\local\\temp",
        "\\appdata\\roaming", "c:\\windows\\tasks", "c:\\perflogs")
    legitimate_service_dirs: list = _lst("c:\\windows\\system32", "c:\\program files", "c:\\program files (x86)")
    startup_folder_markers: list = _lst("\\start menu\\programs\\startup\\")
    run_key_markers: list = _lst("\\software\\microsoft\\windows\\currentversion\\run",
                                 "\\software\\microsoft\\windows\\currentversion\\runonce")
    download_dir_markers: list = _lst("\\downloads\\")
    lnk_extension: str = ".lnk"
    lnk_to_execution_window_s: float = 120.0
    archive_to_execution_window_s: float = 600.0
    removable_drive_letters: list = field(default_factory=lambda: list("DEFGHIJKLMNOPQRSTUVWXYZ"))
    discovery_commands: dict = field(default_factory=lambda: {
        "files": ["dir ", "get-childitem", "type ", "get-content"],
        "users": ["whoami", "net user", "net localgroup", "query user", "get-localuser", "get-localgroup"],
        "system": ["tasklist", "systeminfo", "wmic product get", "get-service", "wmic computersystem"],
        "network": ["ipconfig", "netstat", "netsh advfirewall"],
        "antivirus": ["securitycenter2", "get-mppreference"],
    })
    discovery_window_s: float = 300.0
    discovery_min_distinct_commands: int = 3
    discovery_min_categories: int = 2
    sensitive_data_paths: list = _lst(
        "\\appdata\\roaming\\signal", "wallet.dat", "\\.ssh\\", "\\appdata\\local\\google\\chrome\\user data",
        "\\microsoft sql server\\", "\\appdata\\roaming\\telegram", "\\appdata\\roaming\\discord")
    archive_staging_commands: list = _lst("compress-archive", "7za.exe", "7z.exe", "rar.exe", "winrar")
    credential_keyword_commands: list = _lst("findstr password", "findstr /i password", "select-string password")
    stealer_distinct_category_threshold: int = 3
    stealer_window_s: float = 60.0
    tool_transfer_patterns: list = _lst("certutil.exe", "-urlcache", "curl.exe ", "invoke-webrequest", " iwr ",
                                        "downloadfile(", "downloadstring(", "bitsadmin")
    known_benign_network_images: list = _lst(
        "\\svchost.exe", "\\msedge.exe", "\\chrome.exe", "\\firefox.exe", "\\onedrive.exe", "\\searchapp.exe",
        "\\backgroundtaskhost.exe")
    suspicious_network_process_dirs: list = _lst("\\appdata\\local\\temp", "\\appdata\\roaming", "c:\\programdata",
                                                 "c:\\temp", "c:\\users\\public")
    transfer_to_network_window_s: float = 30.0
    powershell_strong_markers: list = _lst(
        "amsiutils", "amsiinitfailed", "amsiscanbuffer", "invoke-mimikatz", "sekurlsa::", "lsadump::",
        "kerberos::golden", "invoke-kerberoast", "invoke-bloodhound", "sharphound", "invoke-shellcode",
        "invoke-reflectivepeinjection", "out-minidump", "get-gpppassword", "powersploit", "invoke-smbexec",
        "invoke-wmiexec", "invoke-thehash", "invoke-rubeus", "invoke-powerdump", "get-keystrokes",
        "invoke-dcsync", "invoke-tokenmanipulation")
    powershell_weak_markers: list = _lst(
        "invoke-expression", "iex(", "iex (", "frombase64string", "downloadstring", "downloadfile",
        "net.webclient", "virtualalloc", "-bxor", "reflection.assembly]::load", "-windowstyle hidden",
        "-w hidden", "-noprofile", "-nop ", "bypass", "start-bitstransfer", "[char[]]", "gzipstream",
        "-encodedcommand")
    powershell_weak_marker_threshold: int = 3
    max_evidence_events: int = 25


# Default thresholds and lists of the packet rules.
@dataclass
class PacketConfig(_Profile):
    scan_connect_window_floor: int = 1024
    vertical_scan_min_ports: int = 15
    vertical_scan_window_seconds: int = 60
    horizontal_scan_min_hosts: int = 10
    horizontal_scan_window_seconds: int = 60
    udp_scan_min_unreachables: int = 8
    udp_scan_window_seconds: int = 60
    arp_conflict_window_seconds: int = 120
    arp_flood_min_targets: int = 20
    arp_flood_window_seconds: int = 30
    icmp_tunnel_payload_len_floor: int = 64
    icmp_tunnel_min_packets: int = 20
    icmp_tunnel_window_seconds: int = 120
    dns_tunnel_qname_len_floor: int = 40
    dns_tunnel_min_queries: int = 15
    dns_tunnel_window_seconds: int = 120
    dns_tunnel_allowlist: list = _lst(
        "in-addr.arpa", "ip6.arpa", "akamai.net", "akamaiedge.net", "akamaized.net", "cloudfront.net",
        "trafficmanager.net", "azureedge.net", "windowsupdate.com", "googleusercontent.com", "gvt1.com", "gvt2.com",
        "amazonaws.com", "fastly.net", "edgekey.net", "edgesuite.net", "sophosxl.net", "mcafee.com", "spamhaus.org",
        "local", "_tcp.local", "_udp.local")
    bruteforce_min_failures: int = 5
    bruteforce_window_seconds: int = 120
    spray_min_targets: int = 5
    scanner_user_agents: list = _lst("sqlmap", "nmap", "wfuzz", "nikto", "nessus", "acunetix", "havij", "gobuster", "dirbuster")
