"""The parser packs that come with the engine.

Each function returns one pack: how its lines are recognised, how they are taken apart, and which attribute gets
which field. Field names, attribute paths and code tables are the vendors' and the event schema's: fixed values.
"""

from __future__ import annotations

from typing import Any

HTTP_METHODS = {"connect": 1, "delete": 2, "get": 3, "head": 4, "options": 5, "post": 6, "put": 7, "trace": 8}
TEN_STEPS = {"0": 1, "1": 1, "2": 1, "3": 2, "4": 2, "5": 3, "6": 3, "7": 4, "8": 4, "9": 5, "10": 5}
LEAF = r"(?P<v>[^\\]+)$"
HOST = "^(?:[a-z]+://)?(?P<v>[^/:]+)"


def const(value: Any) -> dict:
    return {"const": value}


def enum(field: str, default: Any = None, table: dict | None = None, **more: Any) -> dict:
    """A code looked up by a field's value."""
    out = {"field": field, "map": {**(table or {}), **more}}
    return out if default is None else out | {"default": default}


def stamp(field: Any, fmt: str | None = None) -> dict:
    return {"field": field, "cast": "timestamp"} | ({"format": fmt} if fmt else {})


def low(field: str) -> dict:
    return {"field": field, "cast": "lower"}


def part(field: str, pattern: str) -> dict:
    return {"field": field, "regex": pattern}


def times(field: str, by: int) -> dict:
    return {"field": field, "scale": by}


def one(field: str) -> dict:
    """A list of one value."""
    return {"field": field, "template": "{" + field + "}"}


def unless(field: str, mark: str) -> dict:
    """A field unless it holds the mark for none."""
    return {"field": field, "map": {mark: None}, "map_default_passthrough": True}


def ends(src_ip: Any, src_port: Any, dst_ip: Any, dst_port: Any, prefix: str = "") -> dict:
    """Addresses and ports of both endpoints."""
    return {f"{prefix}src_endpoint.ip": src_ip, f"{prefix}src_endpoint.port": src_port, f"{prefix}dst_endpoint.ip": dst_ip, f"{prefix}dst_endpoint.port": dst_port}


def rule(name: str, class_name: str, when: dict | None = None, activity: Any = None, severity: Any = None, **mapping: Any) -> dict:
    """One class rule; keyword paths spell dots as ``__``."""
    return {"name": name, "class": class_name, "when": when, "activity_id": activity, "severity_id": severity, "mapping": mapping.pop("paths", {}) | mapping}


def pack(ident: str, vendor: str, product: str, priority: int, match: dict, parse: list, mapping: dict, classes: list, severity: Any = None) -> dict:
    return {"id": ident, "version": "1.0", "vendor": vendor, "product": product, "priority": priority, "match": match, "parse": parse, "mapping": mapping, "classes": classes, "severity_id": severity}


def equals(field: str, value: str) -> dict:
    return {"field": field, "equals": value}


def among(field: str, *values: str) -> dict:
    return {"field": field, "in": list(values)}


def fortigate() -> dict:
    verdict = enum("action", 0, accept=1, close=1, timeout=1, deny=2, **{"ip-conn": 2})
    common = {
        "time": [stamp("eventtime"), {"field": ["date", "time"], "join": " ", "cast": "timestamp", "format": "%Y-%m-%d %H:%M:%S"}],
        "device.hostname": "devname", "device.uid": "devid", "device.type_id": const(9), **ends("srcip", "srcport", "dstip", "dstport"),
        "src_endpoint.interface_name": "srcintf", "src_endpoint.zone": "srcintfrole", "src_endpoint.location.country": "srccountry",
        "dst_endpoint.interface_name": "dstintf", "dst_endpoint.zone": "dstintfrole", "dst_endpoint.location.country": "dstcountry", "dst_endpoint.svc_name": "service",
        "connection_info.protocol_num": "proto", "connection_info.protocol_name": enum("proto", table={"6": "tcp", "17": "udp", "1": "icmp", "58": "icmpv6", "47": "gre", "50": "esp"}),
        "connection_info.session.uid": "sessionid", "firewall_rule.uid": "policyid", "message": ["msg", "logdesc"], "actor.user.name": "user",
    }
    traffic = {"traffic.bytes_out": "sentbyte", "traffic.bytes_in": "rcvdbyte"}
    utm = equals("type", "utm")
    return pack(
        "fortinet.fortigate", "Fortinet", "FortiGate", 60, {"formats": ["kv"], "contains": ["devid=", "logid="]}, [{"type": "syslog"}, {"type": "kv", "source": "message"}], common,
        [
            rule("traffic", "network_activity", equals("type", "traffic"), enum("action", 6, accept=6, close=2, timeout=2, deny=5, **{"client-rst": 3, "server-rst": 3, "ip-conn": 4}), paths={"disposition_id": enum("action", 0, accept=1, close=1, timeout=1, deny=2, **{"client-rst": 1, "server-rst": 1, "ip-conn": 2}), "action_id": verdict, **traffic, "traffic.packets_out": "sentpkt", "traffic.packets_in": "rcvdpkt", "duration": times("duration", 1000)}),
            rule("ips", "detection_finding", {"all": [utm, among("subtype", "ips", "anomaly", "virus", "app-ctrl")]}, const(1), enum("severity", 3, info=1, low=2, medium=3, high=4, critical=5), paths={
                "finding_info.title": ["attack", "virus", "app", "msg"], "finding_info.uid": ["attackid", "incidentserialno", "logid"], "finding_info.types": one("subtype"), "finding_info.src_url": "ref",
                "disposition_id": enum("action", 0, dropped=6, blocked=2, reset=21, detected=15, monitored=17, **{"pass": 1}), "action_id": enum("action", 0, dropped=2, blocked=2, reset=2, detected=3, monitored=3, **{"pass": 1}),
                **ends("srcip", "srcport", "dstip", "dstport", "evidences[0]."), "evidences[0].dst_endpoint.hostname": "hostname", "evidences[0].url.url_string": "url"}),
            rule("webfilter", "network_activity", {"all": [utm, equals("subtype", "webfilter")]}, const(6), paths={"url.url_string": "url", "url.hostname": "hostname", "url.categories": one("catdesc"), "disposition_id": enum("action", 0, passthrough=1, blocked=2, monitored=17), "action_id": enum("action", 0, passthrough=1, blocked=2), **traffic}),
            rule("vpn_auth", "authentication", {"all": [equals("type", "event"), equals("subtype", "vpn")]}, enum("action", 1, **{"tunnel-down": 2, "ssl-logout": 2}), paths={"user.name": "user", "src_endpoint.ip": "remip", "status_id": enum("action", 0, **{"ssl-login-fail": 2, "tunnel-up": 1, "ssl-new-con": 1, "tunnel-down": 1}), "status_detail": "reason", "auth_protocol": "tunneltype", "is_remote": const(True), "session.uid": "tunnelid"}),
            rule("other", "network_activity", None, const(99)),
        ],
        enum("level", 1, emergency=6, alert=5, critical=5, error=4, warning=3, notice=2, information=1, debug=1),
    )


def panos() -> dict:
    fmt = "%Y/%m/%d %H:%M:%S"
    shared = "_skip receive_time serial type subtype _skip generated_time src dst natsrc natdst rule srcuser dstuser app vsys from_zone to_zone inbound_if outbound_if log_action _skip sessionid repeatcnt sport dport natsport natdport flags proto action".split()
    layouts = {"TRAFFIC": [*shared, *"bytes bytes_sent bytes_received packets start elapsed category _skip seqno actionflags srcloc dstloc _skip pkts_sent pkts_received session_end_reason".split()], "THREAT": [*shared, *"misc threatid category severity direction seqno actionflags srcloc dstloc".split()]}
    resets = {"reset-client": 21, "reset-server": 21, "reset-both": 21}
    denied = {"reset-client": 2, "reset-server": 2, "reset-both": 2}
    common = {
        "time": stamp("generated_time", fmt), "device.hostname": "syslog_host", "device.uid": "serial", "device.type_id": const(9), **ends("src", "sport", "dst", "dport"),
        "src_endpoint.zone": "from_zone", "src_endpoint.interface_name": "inbound_if", "src_endpoint.location.country": "srcloc",
        "dst_endpoint.zone": "to_zone", "dst_endpoint.interface_name": "outbound_if", "dst_endpoint.location.country": "dstloc",
        "connection_info.protocol_name": low("proto"), "connection_info.session.uid": "sessionid", "firewall_rule.name": "rule", "actor.user.name": "srcuser", "app_name": "app",
    }
    return pack(
        "paloalto.panos", "Palo Alto Networks", "PAN-OS", 60, {"formats": ["csv"], "regex": ",(TRAFFIC|THREAT),"}, [{"type": "syslog"}, {"type": "csv", "source": "message", "columns_by": {"index": 3, "map": layouts}}], common,
        [
            rule("traffic", "network_activity", equals("type", "TRAFFIC"), enum("subtype", 6, start=1, end=2, drop=5, deny=5), paths={
                "disposition_id": enum("action", 0, resets, allow=1, deny=2, drop=6, **{"drop-icmp": 6}), "action_id": enum("action", 0, denied, allow=1, deny=2, drop=2),
                "traffic.bytes": "bytes", "traffic.bytes_out": "bytes_sent", "traffic.bytes_in": "bytes_received", "traffic.packets": "packets", "traffic.packets_out": "pkts_sent", "traffic.packets_in": "pkts_received",
                "start_time": stamp("start", fmt), "duration": times("elapsed", 1000), "status_detail": "session_end_reason"}),
            rule("threat", "detection_finding", equals("type", "THREAT"), const(1), enum("severity", 3, informational=1, low=2, medium=3, high=4, critical=5), paths={
                "finding_info.title": part("threatid", r"^(?P<v>.*?)\s*\(\d+\)$"), "finding_info.uid": part("threatid", r"\((?P<v>\d+)\)$"), "finding_info.types": one("subtype"),
                "disposition_id": enum("action", 0, resets, alert=19, allow=1, deny=2, drop=6, **{"block-url": 2}), "action_id": enum("action", 0, denied, alert=3, allow=1, deny=2, drop=2),
                **ends("src", "sport", "dst", "dport", "evidences[0]."), "evidences[0].url.url_string": "misc"}),
        ],
    )


def asa() -> dict:
    source, target = "%{NOTSPACE:src_zone}:%{IP:src_ip}/%{INT:src_port}", "%{NOTSPACE:dst_zone}:%{IP:dst_ip}/%{INT:dst_port}"
    login = "AAA user authentication %{WORD:auth_result} : "
    texts = [
        rf"%{{WORD:asa_action}} %{{WORD:direction}} %{{WORD:protocol}} connection %{{INT:connection_id}} for {source} \(%{{IP:src_mapped_ip}}/%{{INT:src_mapped_port}}\) to {target} \(%{{IP:dst_mapped_ip}}/%{{INT:dst_mapped_port}}\)",
        f"%{{WORD:asa_action}} %{{WORD:protocol}} connection %{{INT:connection_id}} for {source} to {target} duration %{{NOTSPACE:duration_hms}} bytes %{{INT:bytes}}%{{GREEDYDATA:teardown_reason}}",
        f"%{{WORD:asa_action}} %{{WORD:protocol}} src {source} dst {target} by access-group %{{QS:acl}}",
        login + "reason = %{DATA:auth_reason} : server = %{IP:auth_server} : user = %{USERNAME:user} : user IP = %{IP:src_ip}",
        login + "server = %{IP:auth_server} : user = %{USERNAME:user}",
        "Group <%{DATA:vpn_group}> User <%{DATA:user}> IP <%{IP:src_ip}> IPv4 Address <%{IP:assigned_ip}>%{GREEDYDATA:vpn_detail}",
    ]
    common = {
        "time": stamp("syslog_timestamp"), "device.hostname": "syslog_host", "device.type_id": const(9), **ends("src_ip", "src_port", "dst_ip", "dst_port"),
        "src_endpoint.zone": "src_zone", "dst_endpoint.zone": "dst_zone", "connection_info.protocol_name": low("protocol"), "connection_info.uid": "connection_id",
        "connection_info.direction_id": enum("direction", 0, inbound=1, outbound=2), "message": "message", "metadata.event_code": "asa_msgid",
    }
    number = lambda *ids: among("asa_msgid", *ids)
    return pack(
        "cisco.asa", "Cisco", "ASA", 60, {"contains": ["%ASA-"]},
        [{"type": "syslog"}, {"type": "regex", "source": "syslog_app", "pattern": r"^%(?:ASA|FTD)-(?P<asa_level>\d)-(?P<asa_msgid>\d+)$"}, {"type": "grok", "source": "message", "required": False, "patterns": texts}], common,
        [
            rule("connection", "network_activity", number("302013", "302014", "302015", "302016", "302020", "302021"), enum("asa_action", 6, built=1, teardown=2), paths={"disposition_id": const(1), "action_id": const(1), "traffic.bytes": "bytes", "status_detail": part("teardown_reason", r"^\s*(?P<v>.+)$")}),
            rule("acl_deny", "network_activity", number("106001", "106006", "106007", "106014", "106015", "106021", "106023", "106100", "710003"), const(5), paths={"disposition_id": const(2), "action_id": const(2), "firewall_rule.name": part("acl", '^"(?P<v>[^"]*)"$')}),
            rule("aaa", "authentication", number("113004", "113005", "113012", "113015", "113019", "611101", "611102"), const(1), paths={"user.name": "user", "status_id": enum("auth_result", 0, successful=1, rejected=2, failed=2), "status_detail": "auth_reason", "dst_endpoint.ip": "auth_server"}),
            rule("anyconnect", "authentication", number("722051", "722022", "722023", "722037", "113039"), const(1), paths={"user.name": "user", "status_id": const(1), "is_remote": const(True), "auth_protocol": const("AnyConnect"), "message": "message"}),
            rule("threat_detection", "detection_finding", number("733100", "733101", "733102", "400000", "400013"), const(1), paths={"finding_info.title": part("message", r"^\[\s*(?P<v>[^\]]+)\]"), "finding_info.uid": "asa_msgid"}),
            rule("other", "network_activity", None, const(99)),
        ],
        enum("asa_level", 1, {"0": 6, "1": 5, "2": 5, "3": 4, "4": 3, "5": 2, "6": 1, "7": 1}),
    )


def headed(kind: str, mark: str) -> list[dict]:
    """Stages for a format that may or may not stand behind a syslog header."""
    return [{"type": "syslog", "required": False}, {"type": kind, "source": "message", "when": {"field": "message", "contains": mark}}, {"type": kind, "when": {"field": "device_vendor", "exists": False}, "required": False}]


def checkpoint() -> dict:
    common = {
        "time": stamp("rt"), "device.hostname": ["dvchost", "syslog_host"], "device.ip": "origin", "device.type_id": const(9), **ends("src", "spt", "dst", "dpt"),
        "src_endpoint.interface_name": "deviceInboundInterface", "dst_endpoint.interface_name": "deviceOutboundInterface", "connection_info.protocol_num": "proto",
        "connection_info.protocol_name": enum("proto", table={"6": "tcp", "17": "udp", "1": "icmp"}), "connection_info.direction_id": enum("deviceDirection", 0, {"0": 1, "1": 2}),
        "actor.user.name": "suser", "message": "msg", "metadata.product.name": "device_product",
    }
    return pack(
        "checkpoint.cef", "Check Point", "Quantum Security Gateway", 70, {"formats": ["cef"], "contains": ["|Check Point|"]}, headed("cef", "CEF:"), common,
        [
            rule("threat", "detection_finding", among("device_product", "Anti-Bot", "Anti-Virus", "SmartDefense", "IPS", "Threat Emulation", "Threat Extraction", "URL Filtering"), const(1), paths={
                "finding_info.title": ["cs1", "name"], "finding_info.uid": {"field": ["device_product", "cs1"], "join": ":"}, "finding_info.types": one("cs3"), "malware[0].name": "cs4", "malware[0].classification_ids": {"field": "cs4", "const": [0]},
                "disposition_id": enum("act", 0, prevent=2, drop=6, block=2, detect=15, accept=1, ask=23, inform=17), "action_id": enum("act", 0, prevent=2, drop=2, block=2, detect=3, accept=1),
                **ends("src", "spt", "dst", "dpt", "evidences[0]."), "evidences[0].url.url_string": "request"}),
            rule("firewall", "network_activity", None, enum("act", 6, accept=6, drop=5, reject=5), paths={
                "firewall_rule.name": {"field": "cs2", "when": equals("cs2Label", "Rule Name")}, "disposition_id": enum("act", 0, accept=1, drop=6, reject=25, block=2), "action_id": enum("act", 0, accept=1, drop=2, reject=2, block=2),
                "traffic.bytes_out": "out", "traffic.bytes_in": "in"}),
        ],
        enum("severity", 1, TEN_STEPS),
    )


def srx() -> dict:
    common = {
        "time": stamp("syslog_timestamp"), "device.hostname": "syslog_host", "device.type_id": const(9), **ends("source-address", "source-port", "destination-address", "destination-port"),
        "src_endpoint.zone": "source-zone-name", "src_endpoint.interface_name": "packet-incoming-interface", "dst_endpoint.zone": "destination-zone-name", "dst_endpoint.svc_name": "service-name",
        "connection_info.protocol_num": "protocol-id", "connection_info.protocol_name": enum("protocol-id", table={"6": "tcp", "17": "udp", "1": "icmp", "58": "icmpv6"}),
        "connection_info.session.uid": "session-id-32", "firewall_rule.name": "policy-name", "app_name": "application", "actor.user.name": unless("username", "n/a"), "metadata.event_code": "syslog_msgid",
    }
    allowed, denied = {"disposition_id": const(1), "action_id": const(1)}, {"disposition_id": const(2), "action_id": const(2)}
    of = lambda name: equals("syslog_msgid", f"RT_FLOW_SESSION_{name}")
    return pack(
        "juniper.srx", "Juniper Networks", "SRX Series", 60, {"contains": ["RT_FLOW"]}, [{"type": "syslog", "sd_prefix": False}], common,
        [
            rule("session_create", "network_activity", of("CREATE"), const(1), paths=allowed),
            rule("session_close", "network_activity", of("CLOSE"), const(2), paths={**allowed, "traffic.bytes_out": "bytes-from-client", "traffic.bytes_in": "bytes-from-server", "traffic.packets_out": "packets-from-client", "traffic.packets_in": "packets-from-server", "duration": times("elapsed-time", 1000), "status_detail": "reason"}),
            rule("session_deny", "network_activity", of("DENY"), const(5), paths={**denied, "status_detail": "reason"}),
        ],
    )


def pfsense() -> dict:
    shared = "rule_number sub_rule anchor tracker interface reason action direction ip_version tos ecn ttl ip_id offset ip_flags proto_id proto length src_ip dst_ip".split()
    ports = [*shared, "src_port", "dst_port", "data_length"]
    layouts = {"tcp": [*ports, *"tcp_flags seq ack window urg tcp_options".split()], "udp": ports, "default": shared}
    common = {
        "time": stamp("syslog_timestamp"), "device.hostname": "syslog_host", "device.type_id": const(9), **ends("src_ip", "src_port", "dst_ip", "dst_port"), "src_endpoint.interface_name": "interface",
        "connection_info.protocol_name": low("proto"), "connection_info.protocol_num": "proto_id", "connection_info.direction_id": enum("direction", 0, {"in": 1, "out": 2}),
        "connection_info.tcp_flags": enum("tcp_flags", S=2, SA=18, A=16, F=1, FA=17, R=4, RA=20, PA=24), "firewall_rule.uid": "tracker", "firewall_rule.name": "rule_number", "traffic.bytes": "length",
        "disposition_id": enum("action", 0, block=2, reject=25, **{"pass": 1}), "action_id": enum("action", 0, block=2, reject=2, **{"pass": 1}),
    }
    return pack("pfsense.filterlog", "Netgate", "pfSense / OPNsense", 60, {"contains": ["filterlog"]}, [{"type": "syslog"}, {"type": "csv", "source": "message", "columns_by": {"index": 16, "map": layouts}}], common, [rule("filter", "network_activity", None, enum("action", 6, block=5, reject=5, **{"pass": 6}))])


def sshd() -> dict:
    peer = "from %{IP:src_ip} port %{INT:src_port}"
    texts = [
        f"%{{WORD:auth_result}} %{{WORD:auth_method}} for invalid user %{{USERNAME:user}} {peer} %{{WORD:ssh_proto}}",
        f"%{{WORD:auth_result}} %{{WORD:auth_method}} for %{{USERNAME:user}} {peer} %{{WORD:ssh_proto}}(?:: %{{NOTSPACE:key_type}} %{{NOTSPACE:key_fingerprint}})?",
        f"Invalid user %{{USERNAME:user}} {peer}",
    ]
    common = {
        "time": stamp("syslog_timestamp"), "device.hostname": "syslog_host", "device.type_id": const(1), "src_endpoint.ip": "src_ip", "src_endpoint.port": "src_port", "user.name": "user", "auth_protocol": "auth_method",
        "service.name": const("sshd"), "is_remote": const(True), "message": "message", "status_id": [enum("auth_result", accepted=1, failed=2), {"field": "message", "regex": "^(?P<v>Invalid user)", "map": {"invalid user": 2}}],
    }
    return pack("openssh.sshd", "OpenBSD", "OpenSSH sshd", 55, {"contains": ["sshd["]}, [{"type": "syslog"}, {"type": "grok", "source": "message", "required": False, "patterns": texts}], common, [rule("auth", "authentication", None, const(1))])


def squid() -> dict:
    line = r"^%{NUMBER:ts}\s+%{INT:elapsed_ms} %{IP:client_ip} %{WORD:cache_result}/%{INT:status} %{INT:bytes} %{WORD:method} %{NOTSPACE:url} %{NOTSPACE:user} %{WORD:hierarchy}/%{NOTSPACE:server} %{NOTSPACE:content_type}"
    denied = {"field": "cache_result", "regex": "(?P<v>DENIED)", "map": {"denied": 2}, "default": 1}
    common = {
        "time": stamp("ts"), "device.type_id": const(0), "src_endpoint.ip": "client_ip", "dst_endpoint.ip": {"field": "server", "cast": "ip"}, "dst_endpoint.hostname": part("url", HOST),
        "http_request.http_method": "method", "http_request.url.url_string": "url", "http_request.url.hostname": part("url", HOST), "http_response.code": "status", "http_response.content_type": unless("content_type", "-"),
        "traffic.bytes_in": "bytes", "duration": "elapsed_ms", "actor.user.name": "user", "disposition_id": denied, "action_id": denied,
    }
    return pack("squid.access", "Squid", "Squid Proxy", 55, {"regex": r"^\d{9,10}\.\d{3}\s+\d+ \S+ [A-Z_]+/\d{3} "}, [{"type": "grok", "pattern": line}], common, [rule("access", "http_activity", None, enum("method", 99, HTTP_METHODS))])


def nginx() -> dict:
    line = r'^%{IPORHOST:client_ip} %{NOTSPACE:ident} %{NOTSPACE:auth_user} \[%{HTTPDATE:ts}\] "%{WORD:method} %{NOTSPACE:request_uri} HTTP/%{NUMBER:http_version}" %{INT:status} %{INT:bytes} "%{DATA:referrer}" "%{DATA:user_agent}"'
    common = {
        "time": stamp("ts", "%d/%b/%Y:%H:%M:%S %z"), "src_endpoint.ip": "client_ip", "dst_endpoint.svc_name": const("nginx"), "http_request.http_method": "method", "http_request.url.url_string": "request_uri",
        "http_request.url.path": part("request_uri", "^(?P<v>[^?]*)"), "http_request.url.query_string": part("request_uri", r"\?(?P<v>.*)$"), "http_request.version": "http_version", "http_request.referrer": unless("referrer", "-"),
        "http_request.user_agent": "user_agent", "http_response.code": "status", "http_response.length": "bytes", "actor.user.name": unless("auth_user", "-"), "status_id": {"field": "status", "regex": "^(?P<v>[45])", "map": {"4": 2, "5": 2}, "default": 1},
    }
    return pack("nginx.access", "F5 / NGINX", "NGINX (combined log format)", 50, {"regex": r'^\S+ \S+ \S+ \[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\] "'}, [{"type": "grok", "pattern": line}], common, [rule("access", "http_activity", None, enum("method", 99, HTTP_METHODS))])


def suricata() -> dict:
    common = {
        "time": stamp("timestamp"), "device.type_id": const(13), "device.interface_name": "in_iface", **ends("src_ip", "src_port", "dest_ip", "dest_port"), "connection_info.protocol_name": low("proto"), "connection_info.uid": "flow_id",
        "connection_info.community_uid": "community_id", "app_name": "app_proto", "traffic.bytes_out": "flow.bytes_toserver", "traffic.bytes_in": "flow.bytes_toclient", "traffic.packets_out": "flow.pkts_toserver", "traffic.packets_in": "flow.pkts_toclient",
    }
    kind = lambda name: equals("event_type", name)
    return pack(
        "suricata.eve", "OISF", "Suricata", 65, {"formats": ["json"], "contains": ['"event_type"', '"src_ip"', '"dest_ip"']}, [{"type": "json"}], common,
        [
            rule("alert", "detection_finding", kind("alert"), const(1), enum("alert.severity", 3, {"1": 4, "2": 3, "3": 2, "4": 1}), paths={"finding_info.title": "alert.signature", "finding_info.uid": {"field": ["alert.gid", "alert.signature_id", "alert.rev"], "join": ":"}, "finding_info.types": one("alert.category"), "disposition_id": enum("alert.action", 0, allowed=15, blocked=2), "action_id": enum("alert.action", 0, allowed=3, blocked=2), **ends("src_ip", "src_port", "dest_ip", "dest_port", "evidences[0].")}),
            rule("dns", "dns_activity", kind("dns"), enum("dns.type", 6, query=1, answer=2), paths={"query.hostname": "dns.rrname", "query.type": "dns.rrtype", "query.packet_uid": "dns.id", "rcode": "dns.rcode"}),
            rule("http", "http_activity", kind("http"), enum("http.http_method", 99, HTTP_METHODS), paths={"http_request.http_method": "http.http_method", "http_request.url.hostname": "http.hostname", "http_request.url.path": "http.url", "http_request.url.url_string": {"template": "http://{http.hostname}{http.url}"}, "http_request.user_agent": "http.http_user_agent", "http_request.version": "http.protocol", "http_response.code": "http.status", "http_response.length": "http.length", "http_response.content_type": "http.http_content_type"}),
            rule("tls", "network_activity", kind("tls"), const(6), paths={"tls.sni": "tls.sni", "tls.version": "tls.version", "dst_endpoint.hostname": "tls.sni", "tls.ja3_hash.value": "tls.ja3.hash", "tls.ja3_hash.algorithm_id": const(99)}),
            rule("flow", "network_activity", None, enum("flow.state", 6, new=1, established=6, closed=2), paths={"start_time": stamp("flow.start"), "end_time": stamp("flow.end"), "duration": times("flow.age", 1000), "status_detail": "flow.reason"}),
        ],
    )


def zeek() -> dict:
    common = {"time": stamp("ts"), "device.type_id": const(13), **ends(["id.orig_h", "src"], "id.orig_p", ["id.resp_h", "dst"], "id.resp_p"), "connection_info.protocol_name": "proto", "connection_info.uid": unless("uid", "-")}
    log = lambda name, sign: {"any": [equals("_path", name), {"field": sign, "exists": True}]}
    return pack(
        "zeek.json", "Zeek Project", "Zeek", 65, {"formats": ["json"], "any_contains": ['"id.orig_h"', '"_path"']}, [{"type": "json"}], common,
        [
            rule("conn", "network_activity", log("conn", "conn_state"), enum("conn_state", 6, S0=4, REJ=5, RSTO=3, RSTR=3, SF=2), paths={"app_name": "service", "duration": times("duration", 1000), "traffic.bytes_out": "orig_bytes", "traffic.bytes_in": "resp_bytes", "traffic.packets_out": "orig_pkts", "traffic.packets_in": "resp_pkts", "status_detail": "conn_state"}),
            rule("dns", "dns_activity", log("dns", "qtype_name"), const(2), paths={"query.hostname": "query", "query.type": "qtype_name", "query.class": "qclass_name", "query.packet_uid": "trans_id", "rcode": "rcode_name"}),
            rule("http", "http_activity", log("http", "method"), enum("method", 99, HTTP_METHODS), paths={"http_request.http_method": "method", "http_request.url.hostname": "host", "http_request.url.path": "uri", "http_request.url.url_string": {"template": "http://{host}{uri}"}, "http_request.user_agent": "user_agent", "http_request.length": "request_body_len", "http_response.code": "status_code", "http_response.message": "status_msg", "http_response.length": "response_body_len"}),
            rule("ssh", "ssh_activity", log("ssh", "auth_attempts"), const(1), paths={"protocol_ver": "version", "status_id": enum("auth_success", 0, {"true": 1, "false": 2})}),
            rule("notice", "detection_finding", log("notice", "note"), const(1), const(3), paths={"finding_info.title": "note", "finding_info.uid": {"field": "note", "template": "zeek:{note}"}, "message": "msg", "evidences[0].src_endpoint.ip": "src", "evidences[0].dst_endpoint.ip": "dst"}),
            rule("other", "network_activity", None, const(99)),
        ],
    )


def generic_cef() -> dict:
    blocked = {"block": 2, "blocked": 2, "deny": 2, "allow": 1, "allowed": 1}
    common = {
        "time": stamp("rt"), "metadata.product.vendor_name": "device_vendor", "metadata.product.name": "device_product", "metadata.product.version": "device_version", "device.hostname": ["dvchost", "syslog_host"], "device.ip": "dvc",
        **ends("src", "spt", "dst", "dpt"), "src_endpoint.hostname": "shost", "src_endpoint.mac": "smac", "dst_endpoint.hostname": "dhost", "dst_endpoint.mac": "dmac", "connection_info.protocol_name": low("proto"),
        "actor.user.name": unless("suser", "-"), "message": "msg", "traffic.bytes_out": "out", "traffic.bytes_in": "in",
    }
    return pack(
        "generic.cef", "Generic", "CEF producer", 10, {"formats": ["cef"]}, headed("cef", "CEF:"), common,
        [
            rule("web", "network_activity", {"field": "request", "exists": True}, const(6), paths={"url.url_string": "request", "url.hostname": part("request", "^(?:[a-z]+://)?(?P<v>[^/:?]+)"), "url.categories": one("cat"), "disposition_id": enum("act", 0, blocked, alert=19), "action_id": enum("act", 0, blocked), "status_detail": "name"}),
            rule("network", "network_activity", None, const(6), paths={"disposition_id": enum("act", 0, blocked, drop=6, accept=1), "action_id": enum("act", 0, blocked, drop=2, accept=1)}),
        ],
        enum("severity", 1, TEN_STEPS, low=2, medium=3, high=4, **{"very-high": 5}),
    )


def generic_leef() -> dict:
    common = {
        "time": stamp("devTime"), "metadata.product.vendor_name": "device_vendor", "metadata.product.name": "device_product", "metadata.product.version": "device_version", "metadata.event_code": "event_id", "device.hostname": "syslog_host",
        **ends("src", "srcPort", "dst", "dstPort"), "src_endpoint.mac": "srcMAC", "dst_endpoint.mac": "dstMAC", "connection_info.protocol_name": low("proto"), "actor.user.name": "usrName", "traffic.bytes_out": "srcBytes", "traffic.bytes_in": "dstBytes",
        "disposition_id": enum("action", 0, allow=1, accept=1, permit=1, deny=2, block=2, drop=6), "action_id": enum("action", 0, allow=1, accept=1, permit=1, deny=2, block=2, drop=2),
    }
    steps = {k: v for k, v in TEN_STEPS.items() if k != "0"}
    return pack("generic.leef", "Generic", "LEEF producer", 10, {"formats": ["leef"]}, headed("leef", "LEEF:"), common, [rule("network", "network_activity", None, const(6), message="cat")], enum("sev", 1, steps))


def canonical_alert() -> dict:
    common = {"time": stamp("timestamp"), "device.hostname": "hostname", "device.ip": "agent_ip", "severity_id": "severity_id"}
    title = ["signature_name", "event_type", "tactic", "auth_category", const("Unclassified sensor event")]
    paths = {"finding_info.title": title, "finding_info.uid": "event_uid", "finding_info.attacks[0].tactic.uid": "tactic", "finding_info.types": one("source"), "actor.process.cmd_line": "cmd_line", **ends("src_ip", "src_port", "dst_ip", "dst_port", "evidences[0]."), "evidences[0].connection_info.protocol_name": "proto", "evidences[0].query.hostname": "dns_query"}
    return pack("sensors.canonical_alert", "Multi-sensor", "Canonical sensor alert (Wazuh HIDS / Suricata NIDS / Zeek notice)", 66, {"formats": ["json"], "contains": ['"event_uid"', '"severity_id"']}, [{"type": "json"}], common, [rule("alert", "detection_finding", None, const(1), {"field": "severity_id", "default": 3}, paths=paths)])


def windows() -> dict:
    event = "System.EventID"
    common = {
        "time": [stamp("System.TimeCreated.SystemTime"), stamp("ts")], "device.hostname": ["System.Computer", "computer"], "device.ip": "agentIp", "device.uid": "agentId", "metadata.event_code": event, "metadata.log_name": "System.Channel",
        "metadata.product.feature.name": "System.Provider.Name", "metadata.original_uid": "System.EventRecordID", "actor.user.name": ["User", "SubjectUserName"],
    }
    by = lambda default, **codes: enum(event, default, {k[1:]: v for k, v in codes.items()})  # noqa: E731  e.g. _4624=1
    ids = lambda *numbers: among(event, *map(str, numbers))
    acting, target = {"actor.process.file.path": "Image", "actor.process.pid": "ProcessId"}, {"actor.process.file.path": "SourceImage", "process.file.path": "TargetImage", "process.file.name": part("TargetImage", LEAF)}
    account = {"user.name": "TargetUserName", "user.domain": "TargetDomainName"}
    return pack(
        "microsoft.windows_eventlog", "Microsoft", "Windows EventLog (Sysmon / Security / System / PowerShell)", 70, {"formats": ["json"], "contains": ['"xml"', "<Event"]}, [{"type": "json"}, {"type": "xml", "source": "xml", "windows_eventdata": True}], common,
        [
            rule("process_create", "process_activity", ids(1), const(1), paths={"process.file.path": "Image", "process.file.name": ["OriginalFileName", part("Image", LEAF)], "process.cmd_line": "CommandLine", "process.pid": "ProcessId", "process.uid": "ProcessGuid", "process.integrity": "IntegrityLevel", "process.parent_process.file.path": "ParentImage", "process.parent_process.pid": "ParentProcessId", "process.parent_process.cmd_line": "ParentCommandLine", "actor.process.file.path": "ParentImage", "actor.process.pid": "ParentProcessId"}),
            rule("process_access", "process_activity", ids(10), const(3), paths={**target, "actual_permissions": "GrantedAccess"}),
            rule("remote_thread", "process_activity", ids(8), const(4), paths=target),
            rule("network_connection", "network_activity", ids(3), const(1), paths={**acting, **ends("SourceIp", "SourcePort", "DestinationIp", "DestinationPort"), "dst_endpoint.hostname": "DestinationHostname", "connection_info.protocol_name": low("Protocol"), "connection_info.direction_id": enum("Initiated", 0, {"true": 2, "false": 1})}),
            rule("image_load", "module_activity", ids(7), const(1), paths={**acting, "module.file.path": "ImageLoaded", "module.file.name": part("ImageLoaded", LEAF), "module.load_type_id": const(0)}),
            rule("file_create", "file_activity", ids(11, 9, 17, 18), by(99, _11=1, _9=2, _17=1, _18=14), paths={**acting, "file.path": ["TargetFilename", "Device", "PipeName"], "file.name": [part(n, LEAF) for n in ("TargetFilename", "Device", "PipeName")], "file.type_id": by(0, _17=6, _18=6, _11=1, _9=99)}),
            rule("registry", "registry_value_activity", ids(12, 13, 14), enum("EventType", 2, setvalue=2, deletevalue=4, createkey=2, deletekey=4, renamekey=3), paths={**acting, "reg_value.path": "TargetObject", "reg_value.name": part("TargetObject", r"(?P<v>[^\\]+)\\?$"), "reg_value.data": "Details"}),
            rule("dns_query", "dns_activity", ids(22), const(1), paths={"actor.process.file.path": "Image", "query.hostname": "QueryName"}),
            rule("logon", "authentication", ids(4624, 4625, 4634, 4648), by(1, _4624=1, _4625=1, _4648=1, _4634=2), paths={**account, "logon_type_id": "LogonType", "src_endpoint.ip": "IpAddress", "src_endpoint.hostname": "WorkstationName", "auth_protocol": "AuthenticationPackageName", "session.uid": ["TargetLogonId", "LogonId"], "logon_process.name": "LogonProcessName", "status_id": by(0, _4624=1, _4625=2)}),
            rule("kerberos", "authentication", ids(4768, 4769, 4770, 4771), by(99, _4768=3, _4769=4, _4770=5, _4771=6), paths={**account, "service.name": "ServiceName", "src_endpoint.ip": "IpAddress", "auth_protocol": const("Kerberos")}),
            rule("account_change", "account_change", ids(4720, 4722, 4724, 4725, 4726, 4738, 4728, 4732, 4756, 5136), by(99, _4720=1, _4722=2, _4724=4, _4725=5, _4726=6, _4738=99, _4728=7, _4732=7, _4756=7, _5136=99), paths={**account, "user.name": ["TargetUserName", "ObjectDN"]}),
            rule("service_install", "win_service_activity", ids(7045, 4697, 7031, 7034, 7036), by(99, _7045=1, _4697=1, _7036=3, _7031=4, _7034=4), paths={"win_service.name": "ServiceName", "win_service.cmd_line": ["ImagePath", "ServiceFileName"]}),
            rule("scheduled_task", "scheduled_job_activity", ids(4698, 4699, 4700, 4701, 4702), by(99, _4698=1, _4699=3, _4700=4, _4701=5, _4702=2), paths={"job.name": ["TaskName", "ServiceName"]}),
            rule("powershell_script", "process_activity", ids(4104, 4103, 4688), by(99, _4688=1), paths={"process.file.path": ["Image", "NewProcessName"], "process.file.name": [part("Image", LEAF), part("NewProcessName", LEAF)], "process.cmd_line": "CommandLine", "process.pid": "ProcessId", "actor.process.file.path": ["ParentImage", "Image", "ParentProcessName"]}),
            rule("other", "base_event"),
        ],
    )


def library() -> list[dict]:
    """All packs, by id."""
    made = [fortigate(), panos(), asa(), checkpoint(), srx(), pfsense(), sshd(), squid(), nginx(), suricata(), zeek(), generic_cef(), generic_leef(), canonical_alert(), windows()]
    return sorted(made, key=lambda p: p["id"])
