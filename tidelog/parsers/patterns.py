"""Line patterns of the supported text formats, and the small
patterns read out of their messages. Results depend on them to the letter."""

CLF = r'^(\S+) - (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+)\s*(\S+)?" (\d{3}) (\d+)( "([^"]*)")?( "([^"]*)")?'
ALB = r'^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z) \S+ \S+ \S+ ([0-9.-]+) ([0-9.-]+) ([0-9.-]+) (\d{3}) (\d{3}) \d+ \d+ "([^"]+)" "([^"]+)"'
ENVOY = r'^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\] "(\S+) (\S+) \S+" (\d{3}) \S+ (\d+) (\d+) (\d+) (\d+) ".*?" "(.*?)" "(.*?)"'
JAVA = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\w+)\s+(\d+)\s+---\s+\[(.*?)\]\s+(.*?)\s+:\s+(.*)$"
MONGO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+\+\d{4})\s+(\w+)\s+(\w+)\s+\[(.*?)\]\s+(.*)$"
REDIS = r"^(\d+:[MS])\s+(\d{2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+([.*#])\s+(.*)$"
SYSLOG = r"^<(\d+)>([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:?\s+(.*)$"
K8S = r"^(\S+) (stdout|stderr) F (.*)$"
POSTGRES = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) (\w+) \[(\d+)\] (\S+) (\w+): (.*)$"

HTTP_IN_MESSAGE = r"(GET|POST|PUT|DELETE|PATCH)\s+(\S+)"
MONGO_DURATION = r"(\d+)ms$"
MONGO_COMMAND = r"command: (\w+)"
SYSLOG_STATUS = r"\s(\d{3})(?:\s|$)"
K8S_STATUS = r" (\d{3}) "
K8S_DURATION = r" (\d+)ms"
K8S_COMPONENT = r" (\S+\.go)"
POSTGRES_DURATION = r"duration: ([\d.]+) ms"
POSTGRES_STATEMENT = r"(?i)statement: (\w+)(?:.*?FROM (\w+))?"
