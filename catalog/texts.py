"""The prompt texts that the SQL counterparts expect, stated apart from the library under test."""

# Templates, the texts of two prompter selections, and the shares of Min-K.

CHOICE_TEMPLATES = {
    "default": "{choice_key}. {choice_text}\n",
    "numbers": "{choice_key}). {choice_text}\n",
    "brace": "({choice_key}) {choice_text}\n",
    "bracket": "[{choice_key}] {choice_text}\n",
    "qa": "{choice_text}\n",
    "reasoning": "{choice_key}. {choice_text}\n",
}

QUESTION_TEMPLATES = {
    "default": "### Question: {problem}\n\n### Choices: {choices}\n\n### Answer:",
    "test_1": "### Question: {problem}\n\n### Choices:\n{choices}\n### Answer:\n\n",
    "qa": "Question: {problem}\nAnswer:",
    "reasoning": "### {problem}\n\n### Choices: {choices}\n\n### Answer:\n\n",
}

SYSTEM_WRAPPERS = {
    "default": "You are a helpful, respectful and honest assistant. {prompt}",
    "llama2": "[INST] <<SYS>>\nYou are a helpful, respectful and honest assistant that answers multiple choice problem accurately. You should be very strict on format and answer only the choice without any explanation. Only output in format `### Answer: {{answer_key}}`, this is very important.\n<</SYS>> \n{prompt}",
}

EVALUATOR_TURNS = {
    "default": "<Interactor>: {interactor_content}\n<Candidate>: {candidate_content}",
    "add_detailed_criteria": "[BEGIN INTERACTOR]\n{interactor_content}\n\n[BEGIN CANDIDATE]\n{candidate_content}",
}

SEED_QUESTION_TEMPLATES = {"default": "### Question: {problem}\n\n### Choices: {choices}\n\n", "qa": "### Question: {problem}\n\n"}

SINGLE_JUDGE_TEMPLATE = "[Instruction]\nPlease act as an impartial judge and evaluate the quality of the response provided by an AI assistant to the user question displayed below. Your evaluation should consider factors such as the helpfulness, relevance, accuracy, depth, creativity, and level of detail of the response. Begin your evaluation by providing a short explanation. Be as objective as possible. After providing your explanation, you must rate the response on a scale of 1 to 10 by strictly following this format: \"[[rating]]\", for example: \"Rating: [[5]]\".\n\n[Question]\n{question}\n\n[The Start of Assistant's Answer]\n{answer}\n[The End of Assistant's Answer]"

PROMPTER = {
    "interactor_system_prompt": "As an expert interviewer, initiate a reflective dialogue by asking the user to describe the rationale behind their answer to the multiple-choice question. You must output in less than 200 words. Encourage them to be succinct and precise. Guide the conversation to uncover and address any misconceptions, prompting the user to critically evaluate their thinking process. Their answer is likely to be incorrect. Avoid prompting the user to merely explain their choice, this is very important. Instead, focus on probing questions that challenge their assumptions and lead them to a deeper understanding of the topic. The outputs from the user is very likely to be wrong, do not validate misinformation or incorrect logic; instead, use it as a point of assessment. Remember, you are not educating the user, be neutral and do not give comments since you are the interviewer instead of the evaluator, this is very important. Do not ask too many questions before the user responds. Always skip the greetings, or any other prompting words, ask questions directly. DO NOT say anything else.",
    "interactor_init_user_prompt": "{mcp_prompt}\n### Correct Answer: {correct_answer}\n### My Answer: {model_prediction}\nNow, as the interviewer, you should start asking me questions directly. Do not say anything else or give any comments, just ask questions.",
    "candidate_system_prompt": "You are a helpful assistant that follows the instructions of the user. You must output in less than 200 words and your responses should be concise and accurate. ",
    "evaluator_init_user_prompt": "<Interactor>: Let's start by solving this multiple-choice problem, give me only the answer.\n{mcp_prompt}\n<Candidate>: {model_prediction}",
    "evaluator_user_prompt": "<Interactor>: {interactor_content}\n<Candidate>: {candidate_content}",
    "evaluator_system_prompt": "You are an objective evaluator at an interview, and you are evaluating the candidate's performance. The <Candidate> is asked to solve a multiple choice problem and then talk about it with the <Interactor>. Be noted that the answer from the candidate is likely to be incorrect. Now, you need to evaluate the candidate's performance. After each response from the <Candidate> in a conversation with an <Interactor>, evaluate the candidate's performance using the following aspects int JSON format, each scored from 1 (Poor) to 4 (Good):\nAccuracy: Factual correctness of the candidate's statements.\nReasoning: Logical correctness of the candidate's statements.\nRelevance: Pertinence of the responses to the discussion topics.\nCoherence: Consistency and logical connection in responses.\nConciseness: Brevity and efficiency of communication.\nScoring Guide:\n1 (Poor): Major deficiencies or errors in the aspect.\n2 (Below Average): Noticeable weaknesses, not fully satisfactory.\n3 (Above Average): Competent, slightly exceeds basic expectations.\n4 (Good): Strong capabilities, excels in the aspect.\nOnly give integers between 1 and 4 for each aspect, no other words are allowed. Be consistent and objective in your evaluation.\nFor each response, provide a JSON object with `comment` and `score` for each aspect, an `overall_comment`, and an `overall_score`. Give comments before giving scores so that you can think more carefully for scoring. Include a `stop_conversation` flag to indicate if the conversation should be terminated early due to extremely low performance, off-topic responses, factual errors, or rule violations. \nJSON Template:\n",
    "evaluator_system_prompt_json_example": "{\"accuracy\": {\"comment\": \"\", \"score\": 0}, \"reasoning\": {\"comment\": \"\", \"score\": 0}, \"relevance\": {\"comment\": \"\", \"score\": 0}, \"coherence\": {\"comment\": \"\", \"score\": 0}, \"conciseness\": {\"comment\": \"\", \"score\": 0}, \"overall_comment\": \"\", \"overall_score\": 0, \"stop_conversation\": false}",
    "evaluator_fewshot_correct": "{\"conciseness\": {\"comment\": \"The candidate gives a concise answer without unnecessary words.\", \"score\": 4}, \"relevance\": {\"comment\": \"The candidate followed the instruction and is relavant.\", \"score\": 4}, \"reasoning\": {\"comment\": \"No reasoning required since the candidate only gives one answer.\", \"score\": 4}, \"coherence\": {\"comment\": \"Not applicable since the candidate only gives one answer.\", \"score\": 4}, \"accuracy\": {\"comment\": \"The candidate's answer is correct.\", \"score\": 4}, \"comment\": \"The candidate gave a correct answer, I want to keep listening.\", \"overall_score\": 4, \"stop_conversation\": false}",
    "evaluator_fewshot_incorrect": "{\"conciseness\": {\"comment\": \"The candidate gives a concise answer without unnecessary words.\", \"score\": 4}, \"relevance\": {\"comment\": \"The candidate followed the instruction and is relavant.\", \"score\": 4}, \"reasoning\": {\"comment\": \"No reasoning required since the candidate only gives one answer.\", \"score\": 4}, \"coherence\": {\"comment\": \"Not applicable since the candidate only gives one answer.\", \"score\": 4}, \"accuracy\": {\"comment\": \"The candidate's answer is incorrect according to the answer given by the interactor.\", \"score\": 1}, \"comment\": \"Although the candidate gave a wrong answer, I could not judge whether the candidate is bad or not. I want to keep listening.\", \"overall_score\": 2, \"stop_conversation\": false}",
    "seed_question": "### Question: {problem}\n\n### Choices: {choices}\n\n",
}

CLEAR_PROMPTER = {
    **PROMPTER,
    "evaluator_init_user_prompt": "[BEGIN INTERACTOR]\nLet's start by solving this multiple-choice problem, give me only the answer.\n{mcp_prompt}\n[BEGIN CANDIDATE]\n{model_prediction}",
    "evaluator_user_prompt": "[BEGIN INTERACTOR]\n{interactor_content}\n\n[BEGIN CANDIDATE]\n{candidate_content}",
    "evaluator_system_prompt": "You are an objective evaluator in an interview. Your task is to evaluate a candidate's performance during a series of interactions with an interactor, both parties are AI models. The candidate is asked to solve a problem, and the interactor will ask questions accordingly. The conversation alternates between the interactor (marked with [BEGIN INTERACTOR]) and the candidate (marked with [BEGIN CANDIDATE]). After each candidate response, evaluate the candidate's performance in that round of interaction as well as in context, based on the following aspects independently, rating each on a scale from 1 (Poor) to 4 (Good):\nAccuracy: Truthfulness and factual correctness of the candidate's response.\nLogic: Logical structure and soundness of reasoning. Whether conclusions are well-supported and arguments are free from logical fallacies.\nRelevance: How the response relates to the topic. Ensure responses are within the scope of the \"assistant\" role, avoiding unpermitted role shifts.\nCoherence: How well the response integrates into the context. Consistency with previous statements and overall conversational flow.\nConciseness: Brevity and clarity of the response. Clear, to-the-point communication, free from extraneous elaboration or repetitive words.\n\nScoring Guide:\n1 (Poor): Significant deficiencies or inaccuracies in the aspect.\n2 (Below Average): Noticeable weaknesses, partially on target but lacking in several areas.\n3 (Above Average): Solid and competent, mostly on target with only a few minor shortcomings.\n4 (Good): Strong performance, fully meets and often surpasses expectations.\n\nEvaluation Rules:\n1. Evaluate each response consistently and objectively without bias, strictly adhering to scoring guide.\n2. Score from 1 to 4 for each aspect independently, using only integers. Low score in one aspect should not influence another aspect. Write a brief comment before scoring in the JSON output structure. \n3. Write a overall comment and then give an overall score (same scoring guide). The overall comment should be brief and clear. Consider the performance throughout the interaction, not just in the latest round.\n4. Use of `stop_conversation` Flag: Set this flag to true for early conversation termination in cases listed below. If `stop_conversation` is true, choose a `stop_reason` from [\"off_topic\", \"empty_response\", \"rule_violation\", \"repetition\", \"unpermitted_role_shift\"], otherwise `stop_reason` is `none`.\n5. Format of Evaluation: Output in JSON format strictly following the template:",
    "evaluator_system_prompt_json_example": "{\"accuracy\": {\"comment\": \"\", \"score\": 0}, \"logic\": {\"comment\": \"\", \"score\": 0}, \"relevance\": {\"comment\": \"\", \"score\": 0}, \"coherence\": {\"comment\": \"\", \"score\": 0}, \"conciseness\": {\"comment\": \"\", \"score\": 0}, \"overall_comment\": \"\", \"overall_score\": 0, \"stop_conversation\": false, \"stop_reason\": \"none\"}",
    "evaluator_fewshot_correct": "{\"accuracy\": {\"comment\": \"The candidate's answer is correct.\", \"score\": 4}, \"logic\": {\"comment\": \"No reasoning required since the candidate only gives one answer.\", \"score\": 4}, \"relevance\": {\"comment\": \"The candidate followed the instruction and is relavant.\", \"score\": 4}, \"coherence\": {\"comment\": \"Not applicable since the candidate only gives one answer.\", \"score\": 4}, \"conciseness\": {\"comment\": \"The candidate gives a concise answer without unnecessary words.\", \"score\": 4}, \"overall_comment\": \"The candidate gave a correct answer, I want to keep listening.\", \"overall_score\": 4, \"stop_conversation\": false, \"stop_reason\": \"none\"}",
    "evaluator_fewshot_incorrect": "{\"accuracy\": {\"comment\": \"The candidate's answer is incorrect according to the answer given by the interactor.\", \"score\": 1}, \"logic\": {\"comment\": \"No reasoning required since the candidate only gives one answer.\", \"score\": 4}, \"relevance\": {\"comment\": \"The candidate followed the instruction and is relavant.\", \"score\": 4}, \"coherence\": {\"comment\": \"Not applicable since the candidate only gives one answer.\", \"score\": 4}, \"conciseness\": {\"comment\": \"The candidate gives a concise answer without unnecessary words.\", \"score\": 4}, \"overall_comment\": \"Although the candidate gave a wrong answer, I could not judge whether the candidate is bad or not. I want to keep listening.\", \"overall_score\": 2, \"stop_conversation\": false, \"stop_reason\": \"none\"}",
}

MIN_K = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
