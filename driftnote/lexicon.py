"""The lexicons, weights and parameters that matching and scoring go by. Each is a parameter of the operators that use it."""

from __future__ import annotations

from dataclasses import dataclass

# -- fixed values: cue words
ACTION = ["今天", "目标", "接下来", "下一步", "需要", "必须", "应该", "测试", "修改", "写", "投", "整理", "量化", "记录", "推进", "验证", "闭环"]
BLOCKER = ["卡", "不知道", "缺", "没有", "不够", "失败", "问题", "害怕", "拖延", "延毕", "焦虑", "混乱", "撕扯", "难受", "动不了"]
COMPLETION = ["完成", "做完", "已经", "搞定", "跑通", "出结果", "保存", "写完", "提交", "测出来"]
INCOMPLETE = ["未完成", "没有完成", "还没", "尚未", "缺", "不够", "没封住", "没有数据"]
TIME_PRESSURE = ["今天", "明天", "截止", "提交", "答辩", "最近", "现在", "当前", "下一阶段", "晚上", "早上"]
SIGNAL_RECOVERY = ["EEG", "脑电", "LIF", "SSVEP", "后向散射", "USRP", "波形", "频谱", "PSD", "事件率", "边带", "链路"]
NOVELTY = ["创新", "创新点", "突破", "第一次", "新", "定义", "提出"]
STRONG_HEALTH = ["焦虑", "累", "崩", "睡", "身体", "情绪", "压力", "疲惫", "害怕", "撕扯", "难受"]
SYMBOLS = ["->", "→", "|", "/", "%", "mV", "Hz"]

# -- fixed values: words of each state and topic
KEYWORDS = {
    "Experiment": ["负阻", "测试", "波形", "KS1092", "LIF", "SSVEP", "EEG", "事件率", "RMS", "后向散射", "USRP", "实验", "数据", "ADC", "前端", "阈值", "压缩比", "恢复"],
    "Thesis": ["论文", "第三章", "第四章", "盲审", "答辩", "提交", "证据", "图", "章节", "导师", "逻辑", "写进论文", "创新点", "摘要"],
    "Career": ["简历", "实习", "工作", "求职", "面试", "大模型", "国企", "央企", "应届", "岗位", "投递", "机会", "华为", "GitHub"],
    "AI_Memory": ["AI", "大模型", "agent", "智能体", "记忆", "主动", "RAG", "Obsidian", "skill", "snn", "SNN", "脉冲", "Codex"],
    "Health": ["焦虑", "累", "崩", "睡", "身体", "情绪", "宿舍", "运动", "恢复", "压力", "疲惫", "害怕", "撕扯", "难受", "色情", "吃"],
}
CONTEXT = {
    "Experiment": ["链路", "设备", "仪器", "测量", "参数", "边带", "频谱", "功耗", "闭环", "数据集"],
    "Thesis": ["写作", "润色", "图表", "参考文献", "格式", "数据表达", "答辩故事", "主线"],
    "Career": ["招聘", "公司", "项目经历", "作品", "offer", "HR", "就业", "机会"],
    "AI_Memory": ["向量", "语义", "工具", "模型", "检索", "主动系统", "记忆系统", "状态变量"],
    "Health": ["休息", "睡眠", "眼睛", "腰", "胃", "搬宿舍", "毕业刺激", "自信", "安全感"],
}
TOPICS = {
    "负阻": ["负阻", "negative resistance", "抵消", "斜率"],
    "LIF链路": ["LIF", "后向散射", "USRP", "EEG", "SSVEP", "事件率", "边带", "链路"],
    "实验数据模板": ["跑数据模板", "数据模板", "实验记录数据", "记录数据", "跑数据", "实验数据", "数据闭环"],
    "AI求职转向": ["AI求职", "AI 世界", "大模型机会", "all in AI", "实习", "简历", "大模型"],
    "论文闭环": ["论文", "第三章", "第四章", "摘要", "图", "逻辑", "证据", "主线"],
    "求职": ["简历", "实习", "找工作", "求职", "岗位", "投递", "国企", "应届", "面试"],
    "AI记忆": ["AI", "agent", "智能体", "Obsidian", "记忆", "向量", "主动"],
    "健康恢复": ["焦虑", "累", "崩", "睡", "身体", "情绪", "宿舍", "压力", "害怕", "撕扯", "难受"],
}
TOPIC_PRIORS = {
    "Experiment": {"实验数据模板": 2.2, "LIF链路": 1.8, "负阻": 1.6, "求职": 0.1, "AI记忆": 0.4},
    "Thesis": {"论文闭环": 2.0, "LIF链路": 0.9, "实验数据模板": 0.8},
    "Career": {"AI求职转向": 2.1, "求职": 1.8, "AI记忆": 0.8},
    "AI_Memory": {"AI记忆": 1.7, "AI求职转向": 1.4, "LIF链路": 0.8},
    "Health": {"健康恢复": 2.0},
}
FALLBACK_TOPIC = {"Experiment": "实验闭环", "Thesis": "论文闭环", "Career": "求职", "AI_Memory": "AI记忆", "Health": "健康恢复"}


# -- fixed values: topics that relations know besides, and the words of each role in a relation
MORE_TOPICS = {
    "经济周期": ["经济周期", "周期", "衰退", "复苏", "就业", "库存", "危机", "需求", "供给"],
    "债务金融": ["债务", "杠杆", "信用", "融资", "资产负债表", "银行", "地产", "违约"],
    "激励制度": ["激励", "制度", "产权", "博弈", "监管", "寻租", "道德风险", "委托代理"],
}
RELATION_ROLES = {
    "claim": ["我认为", "本质", "意味着", "创新", "创新点", "核心", "可以理解为", "应该表述为", "主张", "证明", "定义"],
    "conflict": ["但是", "可是", "然而", "矛盾", "冲突", "不理解", "质疑", "难道", "问题", "不对", "不够", "说不通"],
    "failure": ["失败", "测不到", "没有测出来", "没有放大", "不稳定", "不稳", "乱跳", "卡住", "做不出来", "推进不下去", "差点意思"],
    "metric": ["Hz", "hz", "mV", "mv", "Vpp", "RMS", "uA", "μA", "PSD", "FFT", "事件率", "压缩比", "阈值", "sigma", "采样", "数据", "截图", "曲线"],
    "decision": ["决定", "转向", "降级", "主线", "补充", "暂不", "接下来", "下一步", "只做", "收束", "隔离", "关闭", "保留"],
    "emotion": ["焦虑", "害怕", "难受", "崩", "动不了", "失败了", "压力", "延毕", "丢脸", "撕扯"],
    "externality": ["导师", "实验室", "宿舍", "毕业", "延毕", "简历", "投递", "岗位", "公司", "面试", "时间"],
    "question": ["为什么", "如何", "到底", "怎么办", "能不能", "是不是", "该不该", "怎么证明"],
    "novelty": ["新", "第一次", "突然", "发现", "洞察", "涌现", "重新理解", "关系", "连接"],
}
# -- fixed values: terms that name nothing, and pieces that no term has
GENERIC = ["这个", "那个", "什么", "怎么", "为什么", "就是", "然后", "其实", "因为", "所以", "但是", "如果", "现在", "目前", "问题", "东西", "感觉", "可能", "应该", "需要", "一下", "一个", "没有", "还是", "或者", "来说", "的话", "对于", "进行", "比较", "发现"]
GENERIC_PIECES = ["这个", "那个", "什么", "就是", "然后"]
# -- fixed values: spellings of relation types; what a relation does to the topics at its ends: threshold, priority, action, cooldown
RELATION_TYPES = {
    "supports": "support", "supporting": "support", "supported_by": "support", "blocks": "inhibition", "block": "inhibition", "inhibits": "inhibition", "inhibit": "inhibition", "downgrades": "downgrade",
    "downgraded": "downgrade", "reframes": "reframe", "reframing": "reframe", "causes": "causal", "cause": "causal", "co_activation": "bridge", "coactivation": "bridge",
}
RELATION_EFFECTS = {
    "support": [("target", -0.45, "P0", "continue", 0), ("source", -0.15, "P1", "continue", 0)],
    "conflict": [("source", 0.35, "P1", "isolate", 1), ("target", 0.25, "P1", "isolate", 1)],
    "inhibition": [("target", 0.75, "P0", "recover_first", 1), ("source", -0.10, "P1", "continue", 0)],
    "reframe": [("target", -0.25, "P1", "continue", 0), ("source", 0.15, "P2", "downgrade", 2)],
    "downgrade": [("source", 1.00, "P2", "downgrade", 7), ("target", -0.25, "P0", "continue", 0)],
    "causal": [("source", -0.10, "P1", "continue", 0), ("target", -0.25, "P1", "continue", 0)],
    "bridge": [("source", -0.10, "P1", "continue", 0), ("target", -0.10, "P1", "continue", 0)],
    "": [("source", 0.0, "P1", "continue", 0), ("target", 0.0, "P1", "continue", 0)],
}
ACTIONS = ["continue", "downgrade", "isolate", "recover_first", "stop"]


@dataclass(frozen=True)
class Neuron:
    """Parameters of one state's recurrence."""

    theta: float
    decay: float
    reset_ratio: float
    evidence_cap: float
    slow_decay: float
    slow_input: float
    slow_completion: float
    cooldown_days: int = 1
    fast_weight: float = 0.70
    slow_weight: float = 0.30
    completion_cap: float = 2.2


# -- fixed values: one neuron a state
NEURONS = {
    "Experiment": Neuron(7.5, 0.82, 0.35, 6.5, 0.88, 0.40, 0.45),
    "Thesis": Neuron(7.0, 0.84, 0.38, 6.2, 0.92, 0.50, 0.40),
    "Career": Neuron(6.5, 0.80, 0.35, 5.8, 0.96, 0.55, 0.25),
    "AI_Memory": Neuron(7.2, 0.83, 0.36, 6.0, 0.94, 0.50, 0.30),
    "Health": Neuron(5.8, 0.78, 0.40, 5.2, 0.84, 0.30, 0.65),
}
