"""Settings of the sixteen public log collections."""

from __future__ import annotations

from dataclasses import dataclass, field

from lineloom.functions.masking import KEEP_WORDS


@dataclass(frozen=True)
class Preset:
    log_format: str
    masks: tuple[str, ...] = ()
    splitters: str = r"(\s+)"
    st: float = 0.4
    n: int = 3
    method: str = "combined"
    leading_digit: bool = False
    keep_para: bool = True
    keep_words: tuple[str, ...] = field(default=KEEP_WORDS, repr=False)


# Format, masks, splitters, threshold, n-gram length and method per collection.
PRESETS: dict[str, Preset] = {
    "HDFS": Preset(
        "<Date> <Time> <Pid> <Level> <Component>: <Content>",
        (r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"),
        r"(\s+)", 0.7, 3, "seqDist",
    ),
    "Hadoop": Preset(
        r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
        (r"(\d+\.){3}\d+",),
        r"(\s+|\[|\])", 0.65, 4, "seqDist",
    ),
    "Spark": Preset(
        "<Date> <Time> <Level> <Component>: <Content>",
        (r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"),
        r"(\s+|\[|\]|\(|\))", 0.6, 3, "seqDist",
    ),
    "Zookeeper": Preset(
        r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
        (r"(/|)(\d+\.){3}\d+(:\d+)?",),
        r"(\s+)", 0.9, 3, "seqDist", leading_digit=True,
    ),
    "BGL": Preset(
        "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
        (r"core\.\d+",),
        r"(\s+|\(|\)|=)", 0.7, 3, "ngram", leading_digit=True,
    ),
    "HPC": Preset(
        "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
        (r"=\d+",),
        r"(\s+|\(|\))", 0.8, 3, "seqDist", leading_digit=True,
    ),
    "Thunderbird": Preset(
        r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
        (r"(\d+\.){3}\d+",),
        r"(\s+)", 0.6, 2, "seqDist",
    ),
    "Windows": Preset(
        "<Date> <Time>, <Level>                  <Component>    <Content>",
        (r"0x.*?\s",),
        r"(\s+|\{|\})", 0.85, 3, "combined", leading_digit=True,
    ),
    "Linux": Preset(
        r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
        (r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"),
        r"(\s+|\(|\)|=)", 0.65, 3, "combined",
    ),
    "Android": Preset(
        "<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
        (
            r"(/[\w-]+)+",
            r"([\w-]+\.){2,}[\w-]+",
            r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b",
        ),
        r"(\s+|\(|\)|=)", 1.0, 3, "combined",
    ),
    "HealthApp": Preset(
        r"<Time>\|<Component>\|<Pid>\|<Content>",
        (),
        r"(\s+|\[|\]|=)", 0.8, 3, "combined", leading_digit=True,
    ),
    "Apache": Preset(
        r"\[<Time>\] \[<Level>\] <Content>",
        (r"(\d+\.){3}\d+",),
        r"(\s+)", 0.5, 3, "seqDist", leading_digit=True,
    ),
    "Proxifier": Preset(
        r"\[<Time>\] <Program> - <Content>",
        (r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"),
        r"(\s+|\(|\))", 0.8, 3, "ngram", leading_digit=True,
    ),
    "OpenSSH": Preset(
        r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
        (r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"),
        r"(\s+|\(|\)|=|:)", 0.8, 3, "combined", leading_digit=True,
    ),
    "OpenStack": Preset(
        r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
        (r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"),
        r"(\s+|\[|\])", 0.95, 4, "seqDist",
    ),
    "Mac": Preset(
        r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
        (r"([\w-]+\.){2,}[\w-]+",),
        r"(\s+|\[|\]|\(|\)|=)", 0.85, 3, "seqDist", leading_digit=True,
    ),
}
