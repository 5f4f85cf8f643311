"""Column contracts of packets, flows and hosts, and the parameter defaults."""

#: The columns of a packet.
PACKET = "ts double, src string, dst string, proto int, length int, sport int, dport int, flags string"

FLOW_KEYS = ("src", "dst", "portA", "portB", "proto", "t0")
#: The feature contract ``flow-v1``, in order.
FLOW_FEATURES = (
    "n_packets", "n_bytes", "duration", "bytes_per_sec", "pkts_per_sec", "mean_len", "std_len", "min_len", "max_len",
    "mean_iat", "std_iat", "syn_ratio", "ack_ratio", "fin_ratio", "rst_ratio", "psh_ratio", "syn_no_ack",
)
#: The host features, in order.
HOST_FEATURES = (
    "h_packets", "h_bytes", "n_dst", "n_dports", "dports_per_dst", "h_syn_ratio", "h_ack_ratio", "h_rst_ratio",
    "syn_ack_gap", "pkts_per_dst", "h_pkts_per_sec",
)

#: Parameter defaults of the lifecycle.
PARAMETERS = {
    "ingest_floor_percentile": 0.95, "analyst_cut_percentile": 0.99, "quarantine_days": 7.0, "recency_halflife_days": 14.0,
    "gate_max_scenario_drop": 0.10, "gate_max_fpr": 0.02, "window_seconds": 780.0, "stage2_queue_size": 50.0,
}
