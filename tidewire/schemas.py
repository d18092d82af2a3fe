"""Table layouts, written as DDL so that readers and streams can share them."""

MESSAGES = """
    message_id bigint, address string, body string, properties map<string,string>, ts timestamp,
    size bigint, client_id string, user string, receiving_node string,
    original_message_id bigint, group_id string
"""

LIFECYCLE_EVENTS = """
    event_type string, message_id bigint, message_queue string, message_size bigint, ts timestamp,
    node string, client_id string, publish_node string, publish_queue string,
    publish_client_id string, publish_ts timestamp, deliver_ts timestamp
"""

QUEUE_SNAPSHOTS = """
    queue string, time timestamp, message_count bigint, max_message_age bigint, consumers_count bigint,
    group_count bigint, messages_added_frequency double, messages_added bigint
"""

METRICS = "topic string, metric_value double, level int, timestamp bigint"

POINTS = """
    bucket string, measurement string, tags map<string,string>, fields_num map<string,double>,
    fields_str map<string,string>, time timestamp
"""

STEPS = "step string, input_stream string, key_source string, key_expr string"

GROUP_KEYS = "address string, key_source string, key_expr string"
