"""Chat templates and question tables. Everything here is data; rendering is in ``prompts``."""

# Named chat templates (name, system template, system message, role 0, role 1, style, sep, sep2, stop).
TEMPLATES = [
    ("raw", "{system_message}", "", "", "", "NO_COLON_SINGLE", "", None, None),
    (
        "meta-llama-3.1",
        "{system_message}",
        "Cutting Knowledge Date: December 2023\nToday Date: {{currentDateTimev2}}",
        "user",
        "assistant",
        "DEFAULT",
        None,
        None,
        None,
    ),
    ("gemini", "{system_message}", "", "user", "model", "DEFAULT", None, None, None),
    (
        "internlm-chat",
        "{system_message}",
        "A chat between a curious <|User|> and an <|Bot|>. The <|Bot|> gives helpful, detailed, and polite answers "
        "to the <|User|>'s questions.\n\n",
        "<|User|>",
        "<|Bot|>",
        "CHATINTERN",
        "<eoh>",
        "<eoa>",
        "<|User|>",
    ),
    ("mistral", "[INST] {system_message}\n", "", "[INST]", "[/INST]", "LLAMA2", " ", "</s>", None),
    ("llama-2", "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n", "", "[INST]", "[/INST]", "LLAMA2", " ", " </s><s>", None),
    (
        "llama-3",
        "<|start_header_id|>system<|end_header_id|>\n\n{system_message}<|eot_id|>",
        "",
        "user",
        "assistant",
        "LLAMA3",
        "",
        None,
        "<|eot_id|>",
    ),
    (
        "qwen-7b-chat",
        "<|im_start|>system\n{system_message}",
        "You are a helpful assistant.",
        "<|im_start|>user",
        "<|im_start|>assistant",
        "CHATML",
        "<|im_end|>",
        None,
        "<|endoftext|>",
    ),
    (
        "deepseek-chat",
        "{system_message}",
        "<｜begin▁of▁sentence｜>",
        "User",
        "Assistant",
        "DEEPSEEK_CHAT",
        "\n\n",
        "<｜end▁of▁sentence｜>",
        "<｜end▁of▁sentence｜>",
    ),
    ("gemma", "{system_message}", "", "user", "model", "GEMMA", "<end_of_turn>\n", None, "<end_of_turn>"),
    ("gemma-2", "{system_message}", "", "user", "model", "GEMMA", "<end_of_turn>\n", None, "<eos>"),
]
TEMPLATE_SCHEMA = (
    "name string, system_template string, system_message string, role_0 string, role_1 string, style string, "
    "sep string, sep2 string, stop_str string"
)

# Token ids that delimit responses, by model family.
WATCH_TOKENS = {
    "llama-3.2": {"bos": [128000], "eos": [128009], "final_eos": [], "response_start": [128006, 78191, 128007, 271]},
    "qwen2.5": {"bos": [151644], "eos": [151645], "final_eos": [], "response_start": [151645, 198, 151644, 77091, 198]},
    "gemma-2": {"bos": [2], "eos": [107], "final_eos": [1], "response_start": [107, 108, 106, 2516, 108]},
}

# Structured questions (section, key, question, choices).
QUESTIONS = [
    ("QRS", "QRS", "Is a QRS complex present?", ["Yes", "No (Asystole)"]),
    ("QRS", "Pacing", "Is pacing present?", ["Yes", "No"]),
    ("QRS", "Axis", "What is the axis of the QRS complex?", ["normal", "Right/LPFB", "Left/LAFB", "NW"]),
    ("QRS", "Lead reversal", "Is there a lead reversal present?", ["No", "LA/RA", "LA/LL", "RA/RL", "Other"]),
    ("QRS", "Rate", "What is the rate of the QRS complex?", ["Bradycardia", "Tachycardia", "Normal"]),
    ("QRS", "Amplitude", "What is the amplitude of the QRS complex?", ["Normal", "LVH/RVH", "Low"]),
    ("QRS", "Preexcitation", "Is there a preexcitation present?", ["Yes", "No"]),
    ("QRS", "AP", "What is the accessory pathway (AP)?", ["Normal", "Right/LPFB", "Left/LAFG", "NW"]),
    ("QRS", "Duration", "What is the duration of the QRS complex in milliseconds?", ["<110", ">120", "110-120"]),
    ("QRS", ">120", "If the duration is >120, please specify:", ["IVCD", "RBBB", "LBBB"]),
    ("QRS", "110-120", "If the duration is 110-120, please specify:", ["incomplete LBBB", "incomplete RBBB", "Other"]),
    ("QRS", "<110", "If the duration is <110, please specify:", ["rSR complex in V1", "Normal V1"]),
    ("T", "T", "What is the morphology of the T wave?", ["Normal", "Peaked", "Inverted", "Nonspecific"]),
    ("Noise Artifacts", "Noise artifacts", "What kind of noise artifacts are present?", ["Missing lead", "LVAD", "Other noise"]),
]
# Sections in the order in which they are asked.
SECTION_ORDER = ["QRS", "Noise Artifacts", "T"]
# Questions in the order in which they are asked; others are not.
QUESTION_ORDER = [
    "QRS", "Pacing", "Axis", "Lead reversal", "Rate", "Amplitude", "Preexcitation", "AP", "Duration", "Noise artifacts", "T",
]
# Fixed value: the prompt around a report and the questions.
QUESTION_TEMPLATE = """Given the ECG diagnosis: "{report}"

Answer the following questions about this ECG:

{questions}

Respond with a JSON object containing your answers."""
